"""Sliding-window request limits over a history of requests.

A request is accepted while fewer than `limit` accepted requests lie inside the window; rejected requests are
not logged.  Each decision depends on the ones before it, so requests are replayed in time order: tasks stream sorted
rows and remember at most `limit` times.  After a gap as long as the window nothing is remembered, so a key's history
is cut there and its runs are dealt to tasks of their own.  When a run is so busy that it would fill a task, the history
is cut into time slices, too, and only the last `limit` accepted times per key are handed to the next slice.
"""

from collections import deque
from math import ceil

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .running import first_per_group

ROWS_PER_KEY = 1_000_000


class SlidingLog:
    """Accepted times of one key inside the window."""

    def __init__(self, limit, micros, times=()):
        self.limit, self.micros, self.times = limit, micros, deque(times)

    def offer(self, now):
        """0 when accepted, else the whole seconds to wait."""
        while self.times and self.times[0] <= now - self.micros:
            self.times.popleft()
        if len(self.times) < self.limit:
            self.times.append(now)
            return 0
        return max(1, ceil((self.times[0] + self.micros - now) / 1_000_000))


def _replay(limit, micros, columns):
    def run(batches):
        key, log = None, None
        for batch in batches:
            waits = []
            for k, t, carried in zip(batch["_of"], batch["_t"], batch["_carried"]):
                if log is None or k != key:
                    key, log = k, SlidingLog(limit, micros)
                if carried:
                    log.times.append(t)
                    waits.append(0)
                else:
                    waits.append(log.offer(t))
            out = batch[columns].copy()
            out["retry_after"] = pd.Series(waits, index=batch.index, dtype="int64")
            yield out

    return run


def _with_runs(rows, micros):
    """Add `_run`, which rises where a key has been silent for a whole window; rows of a run depend on each other alone.

    Gaps inside a time cell of a window's length are shorter than it, so they are looked for between the cells: a row
    per key and cell is left of the history, pre-aggregated on the map side.
    """
    cell = F.floor(F.col("_t") / micros)
    cells = rows.groupBy("_key", cell.alias("_cell")).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    order = W.partitionBy("_key").orderBy("_cell")
    silent = F.coalesce((F.col("_first") - F.lag("_last").over(order) >= micros).cast("long"), F.lit(0))
    runs = cells.withColumn("_run", silent).select(F.col("_key").alias("_of_key"), F.col("_cell").alias("_of_cell"), F.sum("_run").over(order).alias("_run"))
    same = F.col("_key").eqNullSafe(F.col("_of_key")) & (cell == F.col("_of_cell"))
    return rows.join(runs, same).drop("_of_key", "_of_cell")


def _slices(requests, micros, rows_per_key):
    """Upper time bounds of the slices, so that no key has more than about `rows_per_key` rows in one of them.

    Counts are taken per (key, time cell), pre-aggregated on the map side; one row per cell is left to add up.
    """
    cells = (
        requests.groupBy("_key", F.floor(F.col("_t") / micros).alias("_cell"))
        .agg(F.count("*").alias("_n"))
        .groupBy("_cell")
        .agg(F.max("_n").alias("_n"))
    )
    total = cells.agg(F.sum("_n")).first()[0] or 0
    if total <= rows_per_key:
        return [None]
    order = W.partitionBy(F.lit(0)).orderBy("_cell")  # one row per window length of history
    sliced = cells.withColumn(
        "_slice", F.floor((F.sum("_n").over(order) - F.col("_n")) / F.lit(rows_per_key))
    )
    ends = sliced.groupBy("_slice").agg((F.max("_cell") + 1).alias("_end")).orderBy("_slice").collect()
    return [r["_end"] * micros for r in ends[:-1]] + [None]


def stage_requests(requests, key, time, request_id):
    """The narrow columns that a replay needs; keys are compared as text."""
    return requests.select(
        F.col(key).cast("string").alias("_key"), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"),
        F.lit(False).alias("_carried"), F.col(request_id).alias("_id"),
    )


def replay(staged, limit, seconds, rows_per_key=ROWS_PER_KEY, carry=None):
    """Verdicts (`retry_after`, 0 = accepted) for staged requests; `carry` holds earlier accepted rows per key."""
    micros = seconds * 1_000_000
    columns = ["_key", "_t", "_carried", "_id"]
    schema = f"_key string, _t bigint, _carried boolean, _id {dict(staged.dtypes)['_id']}, retry_after bigint"
    done, start = None, None
    bounds = _slices(staged, micros, rows_per_key)
    for end in bounds:
        part = staged if start is None else staged.filter(F.col("_t") >= start)
        part = part if end is None else part.filter(F.col("_t") < end)
        part = part if carry is None else carry.unionByName(part)
        of = F.concat(F.col("_run").cast("string"), F.coalesce(F.concat(F.lit("|"), "_key"), F.lit("")))
        keyed = _with_runs(part, micros).select(of.alias("_of"), *columns)
        judged = (
            keyed.repartition("_of").sortWithinPartitions("_of", F.desc("_carried"), "_t", "_id")
            .mapInPandas(_replay(limit, micros, columns), schema)
        )
        if len(bounds) > 1:
            judged = cut_lineage(judged)
        carry = last_accepted(judged, limit)
        fresh = judged.filter("not _carried")
        done = fresh if done is None else done.unionByName(fresh)
        start = end
    return done


def last_accepted(judged, limit):
    """What later requests have to know: the last `limit` accepted rows per key."""
    accepted = judged.filter("retry_after = 0").select("_key", "_t", "_carried", "_id")
    return first_per_group(accepted, "_key", F.desc("_t"), F.desc("_id"), n=limit).withColumn("_carried", F.lit(True))


def replay_limits(requests, key, time, request_id, limit, seconds, rows_per_key=ROWS_PER_KEY):
    """(key, request_id, accepted, retry_after) for every request of a history."""
    done = replay(stage_requests(requests, key, time, request_id), limit, seconds, rows_per_key)
    return done.select(
        F.col("_key").cast(dict(requests.dtypes)[key]).alias(key), F.col("_id").alias(request_id),
        (F.col("retry_after") == 0).alias("accepted"), "retry_after",
    )


def rate_groups(method, path):
    """The limit groups a request counts against, as an array of names."""
    ai = (
        (path == "/chat")
        | ((method == "POST") & path.startswith("/generate/"))
        | path.startswith("/summary/file/")
        | path.startswith("/summary/repository/")
    )
    post = method == "POST"
    one = (
        F.when(ai, F.array(F.lit("ai-day"), F.lit("ai")))
        .when(post & path.isin("/repositories/upload", "/repositories/github"), F.array(F.lit("import")))
        .when(post & (path.startswith("/analysis/") | path.endswith("/reindex")), F.array(F.lit("scan")))
        .when(path == "/search", F.array(F.lit("search")))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.concat(F.array(F.lit("all")), one)
