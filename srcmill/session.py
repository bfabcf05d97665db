"""Session defaults and the shared folder used for checkpoints and work tables."""

import tempfile
import uuid

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app="srcmill", master=None, shuffle_partitions=None, **conf):
    """A session with adaptive execution on.  The master comes from spark-submit unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The folder named by spark.checkpoint.dir; a local one is made only for a local master without it (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="srcmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark, label):
    """A fresh path below the shared folder, for a table that later stages read back."""
    return f"{shared_dir(spark).rstrip('/')}/srcmill/{label}-{uuid.uuid4().hex}"


def spread(df):
    """Deal the rows of a small scan over all cores, for work that costs far more per row than per byte.

    `df` must be a plain scan.  One that already has a partition per core is returned as it is, so a large table is
    never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut_lineage(df):
    """Reliable checkpoint: the rows survive the loss of the executors that computed them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
