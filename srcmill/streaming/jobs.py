"""Streams handled batch by batch, and the progress feed: arriving snapshots, shared generation."""

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import rate_limits as L
from ..plans.refresh import changed_rows, commit_changes, refresh_index
from ..session import cut_lineage
from ..sources import changes, store
from .processors import feed_progress

TERMINAL = ("READY", "FAILED")


def progress(updates, patience=86_400, delay="1 hour"):
    """Status changes per repository; the first terminal status ends a repository's feed.

    updates: (repository_id, status, ts).  Read back with `current_progress`.
    """
    return feed_progress(updates, patience, TERMINAL, delay)


def current_progress(written):
    """Per repository the first terminal status, else the newest, of the batches written."""
    row = F.struct("status", "terminal")
    ended = F.min_by(row, F.when(F.col("terminal"), F.col("updated_at")))
    return written.groupBy("repository_id").agg(F.coalesce(ended, F.max_by(row, F.struct("updated_at", "batch"))).alias("_p")).select(
        "repository_id", "_p.status", "_p.terminal"
    )


def index_arrivals(folder, **options):
    """A batch handler that refreshes the stored index with the files of a batch.

    Arriving files add or replace paths.  Each batch writes a new version of the repositories it touched; the list
    of versions is appended last and decides what readers see.
    """

    def handle(batch, number):
        spark = batch.sparkSession
        touched = batch.select("repository_id").distinct()
        tables = {
            name: store.read_current(spark, folder, name, like).join(touched, "repository_id", "left_semi")
            for name, like in store.INDEX_TABLES.items()
        }
        fresh = refresh_index(tables, batch, partial=True, **options)
        store.write_version({n: fresh[n] for n in store.INDEX_TABLES}, folder, number, touched)

    return handle


def index_changes(folder, order, compact_every=8, keep_versions=2, **options):
    """A batch handler that appends what arriving files change to a store of changes (see `sources.changes`).

    A row whose `content` is null removes its path.  Of several rows of a path in one batch, the last by the column
    `order` counts.  A repeated batch finds its commit done; older versions are folded and removed now and then.
    """

    def handle(batch, number):
        spark = batch.sparkSession
        last = batch.groupBy("repository_id", "path").agg(F.max(F.struct(order, F.sha2("content", 256).alias("_hash")))["_hash"].alias("_hash"))
        gone = last.filter("_hash is null").select("repository_id", "path")
        files = changes.read(spark, folder, "files", store.INDEX_TABLES["files"])
        commit_changes(spark, folder, number, changed_rows(files, batch.filter("content is not null"), gone, order=order, **options))
        if number % compact_every == compact_every - 1:
            changes.compact(spark, folder, store.INDEX_TABLES)
            changes.vacuum(spark, folder, keep_versions)

    return handle


def limit_arrivals(folder, key, time, request_id, limit, seconds, rows_per_key=L.ROWS_PER_KEY):
    """A batch handler with the request limits of `replay_limits`, for streams with very busy keys.

    Rows are sorted by Spark and streamed through the replay, so a batch of one key need not fit a task's memory;
    the last accepted times per key are kept as a table, one version per batch.
    """

    def handle(batch, number):
        spark = batch.sparkSession
        staged = L.stage_requests(batch, key, time, request_id)
        kind = dict(staged.dtypes)["_id"]
        state = f"_key string, _t bigint, _carried boolean, _id {kind}"
        earlier = store.read_folder(spark, f"{folder}/kept", state + ", batch long")
        newest = earlier.filter(F.col("batch") < number).agg(F.max("batch")).first()[0]
        carry = earlier.filter(F.col("batch") == newest).drop("batch") if newest is not None else spark.createDataFrame([], state)
        judged = cut_lineage(L.replay(staged, limit, seconds, rows_per_key, carry))
        judged.select(
            F.col("_key").cast(dict(batch.dtypes)[key]).alias(key), F.col("_id").alias(request_id),
            (F.col("retry_after") == 0).alias("accepted"), "retry_after",
        ).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        every = judged.unionByName(carry.withColumn("retry_after", F.lit(0).cast("long")))
        L.last_accepted(every, limit).write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")

    return handle


def admit_arrivals(folder, limit):
    """A batch handler with the outcomes of `replay_admissions`; the slots taken are kept as a table."""
    pair = ["owner_id", "source_key", "revision"]

    def handle(batch, number):
        spark = batch.sparkSession
        held = store.read_folder(
            spark, f"{folder}/slots", ", ".join(f"{c} {dict(batch.dtypes)[c]}" for c in pair) + ", batch long"
        ).filter(F.col("batch") < number).select(*pair)
        requests = batch.withColumn("at", F.struct("created_at", "repository_id"))
        judged = cut_lineage(A.replay_admissions(requests, limit, held))
        judged.select("owner_id", "repository_id", "outcome").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        judged.filter("outcome = 'admitted' and not failed").select(*pair).write.mode("overwrite").parquet(
            f"{folder}/slots/batch={number}"
        )

    return handle


def shared_generation(folder, compute):
    """A batch handler that computes each requested key once and answers every request.

    requests: (request_id, key, text, force).  Saved results are reused unless a request forces a new one; copies
    of a key inside a batch share one computation.  `compute` maps distinct (key, text) rows to (key, result);
    rows without a result are not saved, so they are tried again later.
    """
    schema = "key string, result string, batch long"

    def handle(batch, number):
        spark = batch.sparkSession
        saved = store.read_folder(spark, f"{folder}/results", schema).filter(F.col("batch") < number)
        newest = saved.groupBy("key").agg(F.max_by("result", "batch").alias("saved"))
        wanted = batch.groupBy("key").agg(F.any_value("text").alias("text"), F.max("force").alias("force"))
        todo = wanted.join(newest, "key", "left").filter(F.col("saved").isNull() | F.col("force"))
        made = compute(todo.select("key", "text")).filter(F.trim(F.coalesce("result", F.lit(""))) != "")
        made.select("key", "result").write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        fresh = spark.read.schema("key string, result string").parquet(f"{folder}/results/batch={number}").withColumnRenamed(
            "result", "fresh"
        )
        answers = batch.join(fresh, "key", "left").join(newest, "key", "left").select(
            "request_id", "key", F.coalesce("fresh", "saved").alias("result"), F.col("fresh").isNull().alias("reused")
        )
        answers.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return handle
