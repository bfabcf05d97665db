"""Keyed state of streams ends: state rows are counted batch by batch."""

from pyspark.sql import functions as F
from test_plans import arrive

from srcmill.streaming import jobs as J
from srcmill.streaming import processors as S
from srcmill.streaming.runner import catch_up

CLOCK = 10_000_000  # event time far behind everything else


def run(spark, tmp_path, batches, schema, job):
    stream = arrive(spark, str(tmp_path / "in"), batches, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    rows = []
    out = catch_up(job(stream), folder=str(tmp_path / "o"), progress=rows)
    return spark.read.parquet(out + "/out"), rows


def test_progress_feeds_end(spark, tmp_path):
    first = [(i, "PARSING", i) for i in range(40)]
    second = [(i, "READY" if i % 2 else "INDEXING", 100 + i) for i in range(40)] + [(1, "FAILED", 50), (3, "PARSING", 300)]
    last = [(99, "PARSING", CLOCK)]
    written, rows = run(spark, tmp_path, [first, second, last], "repository_id long, status string, s long", lambda s: J.progress(s, patience=600))
    got = {r.repository_id: (r.status, r.terminal) for r in J.current_progress(written).collect()}
    want = {i: ("READY", True) if i % 2 else ("INDEXING", False) for i in range(40)} | {1: ("FAILED", True), 99: ("PARSING", False)}
    assert got == want
    assert max(rows) >= 40 and rows[-1] <= 3


def test_replies_end(spark, tmp_path):
    first = [(i, 0, f"text {i}", False, i) for i in range(30)]
    second = [(i, 1, None, True, 40 + i) for i in range(0, 30, 2)]
    late = [(0, 2, "late", False, 80)]
    last = [(99, 0, "tick", False, CLOCK)]
    tokens = "reply_id long, seq int, token string, is_end boolean, s long"
    written, rows = run(spark, tmp_path, [first, second, late, last], tokens, lambda s: S.assemble_replies(s, patience=300))
    got = {r.reply_id: (r.status, r.content) for r in written.collect()}
    assert got == {i: ("FAILED", None) if i % 2 else ("COMPLETED", f"text {i}") for i in range(30)} and written.count() == 30
    assert max(rows) >= 30 and rows[-1] <= 20  # the failed ones are remembered for the patience


def test_jobs_end(spark, tmp_path):
    first = [(i, "RUNNING", i) for i in range(30)]
    second = [(i, "READY", 200 + i) for i in range(0, 30, 3)]
    last = [(99, "READY", CLOCK)]
    written, rows = run(spark, tmp_path, [first, second, last], "job_id long, status string, s long", lambda s: S.watch_stalled(s, 300))
    assert sorted(r.job_id for r in written.collect()) == [i for i in range(30) if i % 3]
    assert max(rows) >= 30 and rows[-1] <= 3
