"""Running a stream over a table folder until it is caught up, and reading its output back."""

from pyspark.sql import functions as F

from ..session import STATE_STORE, work_path

FILES_PER_TRIGGER = 16


def read_table_stream(spark, path, files_per_trigger=FILES_PER_TRIGGER):
    """A file stream with the schema of the table.  A batch, and so any key in it, is bounded by its files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(_as_glob(path))


def _as_glob(path):
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/{name[:-1]}[{name[-1]}]" if name.endswith(".parquet") else path


def use_state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def write_by_time(df, column, folder, slices, files=2):
    """Write a table in time order, `files` files a slice, so that a file stream takes in a slice after the other."""
    first, last = df.agg(F.min(column).cast("timestamp"), F.max(column).cast("timestamp")).first()
    at = F.unix_micros(F.col(column).cast("timestamp"))
    start, end = (F.unix_micros(F.lit(t)) for t in (first, last))
    number = F.floor((at - start) * slices / (end - start + 1))
    for n in range(slices):
        df.filter(number == n).repartition(files).write.mode("append").parquet(folder)
    return folder


def catch_up(stream, mode="append", label="stream", folder=None, progress=None):
    """Process everything that has arrived; returns the folder of the output table.

    Every batch writes its own partition, so a batch that runs again after a failure replaces its own rows.  A list
    given as `progress` receives the number of state rows after each batch.
    """
    spark = stream.sparkSession
    use_state_store(spark)
    folder = folder or work_path(spark, label)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = (
        stream.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start()
    )
    run.awaitTermination()
    if progress is not None:
        progress += [sum(operator.numRowsTotal for operator in p.stateOperators) for p in run.recentProgress]
    return folder


def run_batches(stream, handle, label="stream", folder=None):
    """Drive a batch function (DataFrame, batch number) with the arriving rows."""
    spark = stream.sparkSession
    use_state_store(spark)
    folder = folder or work_path(spark, label)
    (
        stream.writeStream.foreachBatch(handle).trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    )
    return folder


def event_time(stream, column, delay="1 minute"):
    """A watermark on a zone-less timestamp column, which has to become a timestamp first."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)
