"""Registered queries that run as streams over the table files until they are caught up."""

from pyspark.sql import functions as F

from ..session import work_path
from ..sources import store
from ..streaming import jobs as J
from ..streaming import processors as S
from ..streaming.runner import catch_up, read_table_stream, run_batches, write_by_time
from .catalog_accounts import SQL_LIMITER, STATUS
from .registry import SQL, stream_query


@stream_query("stream_rate_limit", SQL_LIMITER)
def stream_rate_limit(spark, sf_dir):
    events = read_table_stream(spark, f"{sf_dir}/events.parquet")
    folder = catch_up(S.limit_requests(events, "user_id", "ts", "event_id", 2, 86400), label="limits")
    return spark.read.parquet(f"{folder}/out").drop("batch")


@stream_query("stream_limit_batches", SQL_LIMITER)
def stream_limit_batches(spark, sf_dir):
    """The same limits for very busy keys: sorted batches with a carried table instead of keyed state."""
    folder = work_path(spark, "limit-batches")
    events = read_table_stream(spark, f"{sf_dir}/events.parquet")
    run_batches(events, J.limit_arrivals(folder, "user_id", "ts", "event_id", 2, 86400), folder=folder)
    return spark.read.parquet(f"{folder}/out").drop("batch")


@stream_query("stream_admissions", SQL["admission_replay"])
def stream_admissions(spark, sf_dir):
    folder = catch_up(S.admit_imports(import_requests(spark, sf_dir), limit=3), label="admissions")
    return spark.read.parquet(f"{folder}/out").drop("batch")


@stream_query("stream_admission_batches", SQL["admission_replay"])
def stream_admission_batches(spark, sf_dir):
    """The same outcomes for owners with very many requests: joins per batch and a table of taken slots."""
    folder = work_path(spark, "admission-batches")
    run_batches(import_requests(spark, sf_dir), J.admit_arrivals(folder, 3), folder=folder)
    return spark.read.parquet(f"{folder}/out").drop("batch")


def import_requests(spark, sf_dir):
    statuses = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return read_table_stream(spark, f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("repository_id"),
        F.col("o_orderpriority").alias("source_key"), F.year("o_orderdate").cast("string").alias("revision"),
        (statuses[F.col("o_orderstatus")] == "FAILED").alias("failed"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


@stream_query(
    "stream_progress",
    """WITH u AS (SELECT user_id AS repository_id, ts, CASE WHEN event_type = 'purchase' AND value > 70 THEN 'READY' WHEN event_type = 'error'
      AND value > 90 THEN 'FAILED' WHEN event_type = 'click' THEN 'PARSING' ELSE 'INDEXING' END AS status,
      (event_type = 'purchase' AND value > 70) OR (event_type = 'error' AND value > 90) AS ended FROM events)
    SELECT repository_id, coalesce(arg_min(status, ts) FILTER (ended), arg_max(status, ts)) AS status, bool_or(ended) AS terminal
    FROM u GROUP BY repository_id""",
)
def stream_progress(spark, sf_dir):
    folder = catch_up(J.progress(repository_updates(read_table_stream(spark, f"{sf_dir}/events.parquet"))), label="progress")
    return J.current_progress(spark.read.parquet(f"{folder}/out"))


def repository_updates(events):
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        F.col("user_id").alias("repository_id"), "ts",
        F.when((kind == "purchase") & (value > 70), "READY").when((kind == "error") & (value > 90), "FAILED")
        .when(kind == "click", "PARSING").otherwise("INDEXING").alias("status"),
    )


def by_time(spark, sf_dir, slices=4):
    """The events as a stream of several batches, in order of time."""
    folder = write_by_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", work_path(spark, "by-time"), slices)
    return read_table_stream(spark, folder, files_per_trigger=2)


@stream_query("stream_progress_batches", SQL["stream_progress"])
def stream_progress_batches(spark, sf_dir):
    folder = catch_up(J.progress(repository_updates(by_time(spark, sf_dir))), label="progress")
    return J.current_progress(spark.read.parquet(f"{folder}/out"))


@stream_query("stream_limit_by_time", SQL_LIMITER)
def stream_limit_by_time(spark, sf_dir):
    folder = catch_up(S.limit_requests(by_time(spark, sf_dir), "user_id", "ts", "event_id", 2, 86400), label="limits")
    return spark.read.parquet(f"{folder}/out").drop("batch")


@stream_query(
    "stream_replies",
    """SELECT conv_id * 100 + turn AS reply_id, CASE WHEN conv_id % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
      CASE WHEN conv_id % 5 <> 0 THEN text END AS content FROM conversations WHERE role = 'assistant'""",
)
def stream_replies(spark, sf_dir):
    """Words of the assistant turns as token events; every fifth conversation never sends its end marker."""
    pieces = F.regexp_extract_all("text", F.lit(r"(?s)\S+\s*|\s+"), F.lit(0))
    ended = F.col("conv_id") % 5 != 0
    steps = F.when(ended, F.array_append(pieces, F.lit(None).cast("string"))).otherwise(pieces)
    replies = read_table_stream(spark, f"{sf_dir}/conversations.parquet")
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 10 + F.col("turn"))
    # one clock event behind the last reply lets the timers of the silent ones expire
    tokens = replies.filter("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("reply_id"), start.alias("ts"), F.posexplode(steps).alias("seq", "token")
    ).withColumn("is_end", F.col("token").isNull())
    clock = replies.filter("conv_id = 0 and turn = 0").select(
        F.lit(-1).cast("long").alias("reply_id"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"), F.lit(0).alias("seq"),
        F.lit("tick").alias("token"), F.lit(True).alias("is_end"),
    )
    folder = catch_up(S.assemble_replies(tokens.unionByName(clock)), label="replies")
    return spark.read.parquet(f"{folder}/out").drop("batch").filter("reply_id >= 0")


@stream_query(
    "stream_stalled",
    """WITH l AS (SELECT user_id, max(ts) AS seen, arg_max(event_type, ts) AS kind FROM events GROUP BY user_id)
    SELECT user_id AS job_id, CASE kind WHEN 'view' THEN 'RUNNING' ELSE 'PENDING' END AS status, epoch_us(seen) // 1000 AS silent_since FROM l
    WHERE kind NOT IN ('purchase', 'error') AND epoch_us(seen) // 1000 + 900000 <= (SELECT epoch_us(max(ts)) // 1000 - 60000 FROM events)""",
)
def stream_stalled(spark, sf_dir):
    folder = catch_up(S.watch_stalled(job_updates(read_table_stream(spark, f"{sf_dir}/events.parquet")), 900), label="stalled")
    return spark.read.parquet(f"{folder}/out").drop("batch")


def job_updates(events):
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("job_id"), "ts",
        F.when(kind == "purchase", "READY").when(kind == "error", "FAILED").when(kind == "view", "RUNNING")
        .otherwise("PENDING").alias("status"),
    )


@stream_query(
    "stream_stalled_batches",
    """WITH e AS (SELECT user_id, ts, event_type AS kind, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS later,
      floor((epoch_us(ts) - epoch_us(min(ts) OVER ())) * 4 / (epoch_us(max(ts) OVER ()) - epoch_us(min(ts) OVER ()) + 1)) AS slice FROM events),
    b AS (SELECT slice, epoch_us(max(ts)) // 1000 - 60000 AS mark FROM e GROUP BY slice),
    s AS (SELECT *, floor((epoch_us(later) - epoch_us((SELECT min(ts) FROM e))) * 4 / (epoch_us((SELECT max(ts) FROM e)) - epoch_us((SELECT min(ts) FROM e)) + 1)) AS next FROM e)
    SELECT user_id AS job_id, CASE kind WHEN 'view' THEN 'RUNNING' ELSE 'PENDING' END AS status, epoch_us(ts) // 1000 AS silent_since FROM s JOIN b USING (slice)
    WHERE kind NOT IN ('purchase', 'error') AND (later IS NULL OR next > slice)
      AND epoch_us(ts) // 1000 + 900000 <= (SELECT max(mark) FROM b WHERE later IS NULL OR b.slice < next - 1)""",
)
def stream_stalled_batches(spark, sf_dir):
    """Several batches: a job is reported by a batch that brings nothing of it, once the one before has proved its silence."""
    folder = catch_up(S.watch_stalled(job_updates(by_time(spark, sf_dir)), 900), label="stalled")
    return spark.read.parquet(f"{folder}/out").drop("batch")


@stream_query(
    "stream_generation",
    """SELECT doc_id AS request_id, md5(text) AS key, 'words: ' || len(string_split(text, ' ')) AS result, false AS reused FROM documents""",
)
def stream_generation(spark, sf_dir):
    requests = read_table_stream(spark, f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("request_id"), F.md5("text").alias("key"), "text", F.lit(False).alias("force")
    )
    folder = work_path(spark, "generation")
    result = F.concat(F.lit("words: "), F.size(F.split("text", " ")).cast("string"))
    run_batches(requests, J.shared_generation(folder, lambda todo: todo.select("key", result.alias("result"))), folder=folder)
    return spark.read.parquet(f"{folder}/out").drop("batch")


@stream_query(
    "stream_index",
    f"""SELECT source AS repository_id, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents
    WHERE octet_length(encode(text)) <= 1048576 GROUP BY source""",
)
def stream_index(spark, sf_dir):
    """Documents arrive as Go files and drive the incremental index."""
    arrivals = read_table_stream(spark, f"{sf_dir}/documents.parquet").select(
        F.col("source").alias("repository_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".go")).alias("path"),
        F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"),
    )
    folder = work_path(spark, "arrivals")
    run_batches(arrivals, J.index_arrivals(folder, dimensions=64), folder=folder)
    files = store.read_current(spark, folder, "files", store.INDEX_TABLES["files"])
    return files.groupBy("repository_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
