import random

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from srcmill.operators import prompts as P
from srcmill.operators.rate_limits import SlidingLog
from srcmill.plans import index, refresh, scan
from srcmill.sources import store, tree
from srcmill.streaming import jobs as J
from srcmill.streaming import processors as S
from srcmill.streaming.runner import catch_up, run_batches

TREE = {
    "r/src/main.py": "import helpers\n\nclass App:\n    def run(self):\n        return helpers.go()\n\n\nVALUE = 1\nOTHER = 2\nMORE = 3\n",
    "r/src/helpers.py": "def go():\n    return eval('1')\n",
    "r/web/index.ts": "import x from './x'\nexport function start(a) {\n  return a\n}\n",
    "r/data/settings.json": '{"service":{"name":"forecast"},"enabled":true}',
    "r/broken.py": "def (\n", "r/tool.go": "package main\n\nfunc main() {}\n", "r/readme.md": "# x\n", "q/only.py": "x = 1\n",
}


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_index_tables(spark, tmp_path):
    write(tmp_path, TREE)
    tables = index.index_tree(tree.read_source_tree(spark, str(tmp_path)), dimensions=32)
    files = {(f.repository_id, f.path): f for f in tables["files"].collect()}
    assert set(p for r, p in files if r == "r") == {k[2:] for k in TREE if k.startswith("r/")}
    main = files[("r", "src/main.py")]
    # 'main' (30) + entry point (25) + two symbols (4) + one import (2)
    assert (main.num_classes, main.num_functions, main.complexity_score, main.importance_score) == (1, 1, 1.0, 61.0)
    helpers = files[("r", "src/helpers.py")]
    # 'helpers' (15) + one symbol (2) + one dependent (5)
    assert (helpers.importance_score, helpers.importance_level) == (22.0, "LOW")
    assert files[("r", "broken.py")].importance_score == 0.0
    symbols = {(s.name, s.type, s.start_line, s.end_line) for s in tables["symbols"].filter("repository_id = 'r'").collect()}
    assert {("App", "class", 3, 5), ("run", "method", 4, 5), ("start", "function", 2, 4), ("/service", "json_path", 2, 4)} <= symbols
    chunks = tables["code_chunks"].filter("file_path = 'src/main.py'").orderBy("chunk_index").collect()
    assert [(c.symbol_name, c.symbol_type, c.start_line, c.end_line) for c in chunks] == [
        ("App", "class", 3, 5), ("run", "method", 4, 5), (None, "module_level", 6, 10)
    ]
    assert tables["code_chunks"].filter("file_path = 'broken.py'").count() == 0
    assert tables["vectors"].count() == tables["code_chunks"].count()
    totals = {t.repository_id: t for t in tables["totals"].collect()}
    assert totals["r"].total_files == 7 and totals["r"].languages == {"python": 3, "typescript": 1, "json": 1, "go": 1}
    paired = tables["vectors"].join(tables["code_chunks"], "id").filter(F.col("document") != F.col("content"))
    assert paired.count() == 0
    line = P.important_file_lines(tables["files"]).filter("repository_id = 'r'").first().important_files.split("\n")[0]
    assert line == "- src/main.py (importance: HIGH, 1 classes, 1 functions)"


def snapshot(spark, root):
    return tree.read_source_tree(spark, str(root))


def test_refresh_touches_only_changes(spark, tmp_path):
    write(tmp_path / "a", TREE)
    tables = index.index_tree(snapshot(spark, tmp_path / "a"), dimensions=16)
    index.write_index(tables, str(tmp_path / "store"))
    folder = str(tmp_path / "store")
    stored = {n: store.read_current(spark, folder, n, like) for n, like in store.INDEX_TABLES.items()}
    stored["repository_jobs"] = spark.createDataFrame(
        [("r", "ANALYSIS", "COMPLETED"), ("q", "ANALYSIS", "COMPLETED")], "repository_id string, job_type string, status string"
    )
    same = refresh.refresh_index(stored, snapshot(spark, tmp_path / "a"), dimensions=16)
    assert {(c.updated, c.added, c.deleted) for c in same["changes"].collect()} == {(0, 0, 0)}
    assert same["vectors"].count() == stored["vectors"].count()
    changed = {k: v for k, v in TREE.items() if k != "r/web/index.ts"}
    changed["r/src/helpers.py"] = "def go():\n    return 2\n\ndef more():\n    return 3\n"
    changed["r/src/new.py"] = "def fresh():\n    return 1\n"
    write(tmp_path / "b", changed)
    out = refresh.refresh_index(stored, snapshot(spark, tmp_path / "b"), dimensions=16)
    counts = {c.repository_id: (c.unchanged, c.updated, c.added, c.deleted) for c in out["changes"].collect()}
    assert counts == {"r": (5, 1, 1, 1), "q": (1, 0, 0, 0)}
    names = {s.name for s in out["symbols"].collect()}
    assert {"more", "fresh", "App"} <= names and "start" not in names
    assert out["vectors"].count() == out["code_chunks"].count()
    assert {j.repository_id: j.status for j in out["repository_jobs"].collect()} == {"r": "STALE", "q": "COMPLETED"}
    index.write_index(out, folder, 2)  # into the store that it is read from
    again = store.read_current(spark, folder, "symbols", store.INDEX_TABLES["symbols"])
    assert {s.name for s in again.collect()} == names
    stored.update({n: store.read_current(spark, folder, n, like) for n, like in store.INDEX_TABLES.items()})
    bare = snapshot(spark, tmp_path / "b").filter("path like '%.md' or repository_id = 'q'")
    index.write_index(refresh.refresh_index(stored, bare, dimensions=16), folder, 3, spark.createDataFrame([("r",), ("q",)], "repository_id string"))
    assert store.read_current(spark, folder, "symbols", store.INDEX_TABLES["symbols"]).filter("repository_id = 'r'").count() == 0
    stored.update({n: spark.read.parquet(f"{folder}/{n}/version=1") for n in store.INDEX_TABLES})
    renewed = refresh.refresh_index(stored, snapshot(spark, tmp_path / "a"), version_changed=True, dimensions=16)
    assert renewed["changes"].agg(F.sum("updated")).first()[0] == 8
    assert renewed["vectors"].count() == stored["vectors"].count()


def test_published_findings_follow_the_newest_run(spark, tmp_path):
    def files(text):
        return spark.createDataFrame([("r", "f", "a.py", "python", text)], "repository_id string, file_id string, path string, language string, text string")

    def runs(id, second):
        return spark.createDataFrame([("r", id, "COMPLETED", second)], "repository_id string, id string, status string, created_at long")

    folder = str(tmp_path)
    scan.publish_scan(scan.scan_files(files("eval('1')\n")), folder, runs("run1", 1))
    scan.publish_scan(scan.scan_files(files("eval('1')\n")), folder, runs("run1", 1))  # a repeated attempt
    scan.publish_scan(scan.scan_files(files("x = 1\n")), folder, runs("run2", 2))
    issues, jobs = spark.read.parquet(f"{folder}/analysis_issues"), spark.read.parquet(f"{folder}/repository_jobs")
    assert scan.current_findings(issues, jobs).count() == 0
    assert scan.current_findings(issues, jobs.filter("id = 'run1'")).count() == 1


def arrive(spark, folder, batches, schema):
    """Each batch becomes one file; a stream takes them in one by one."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        newest = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getctime)
        os.utime(newest, (time.time() - 1000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_path_twice_in_a_batch(spark):
    rows = [("r", "a.py", b"x = 1\n", 6, 2), ("r", "a.py", b"y = 2\n", 6, 1), ("r", "a.py", b"x = 1\n", 6, 2), ("r", "b.py", b"", 0, 1)]
    files = spark.createDataFrame(rows, "repository_id string, path string, content binary, size bigint, arrived int")
    assert sorted(tuple(r)[1:3] for r in refresh.latest_files(files, "arrived").collect()) == [("a.py", b"x = 1\n"), ("b.py", b"")]
    assert refresh.latest_files(files.drop("arrived")).count() == 2


def test_contents_are_shuffled_once(spark):
    rows = [("r", f"f{i % 40}.py", f"x = {i}\n".encode(), 8, i) for i in range(80)]
    files = spark.createDataFrame(rows, "repository_id string, path string, content binary, size bigint, arrived int")
    latest = refresh.latest_files(files, "arrived")
    again = latest.select("repository_id", "path").filter("path <> 'f0.py'")
    plan = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    both = latest.join(again.hint("merge"), ["repository_id", "path"], "left_semi")
    assert len(plan(latest)) == 1 and len(plan(refresh.latest_hashes(files, "arrived"))) == 1
    assert len(plan(both)) == 2  # one of them without contents
    assert {r.path: r.arrived for r in both.collect()} == {f"f{i}.py": 40 + i for i in range(1, 40)}


def test_rows_become_python_values_in_slices(spark):
    """Wide rows: what a worker holds as Python values at a time is bounded, and all rows come out."""
    from srcmill.operators import arrow_map

    batch = pa.RecordBatch.from_pydict({"id": range(100), "text": ["x" * 100_000] * 100})
    parts = list(arrow_map._slices(batch, ["text"]))
    assert len(parts) == 50 and sum(p.num_rows for p in parts) == 100
    assert len(list(arrow_map._slices(batch.slice(0, 0), ["text"]))) == 0
    df = spark.range(1000, numPartitions=1).withColumn("text", F.repeat(F.lit("ab"), 5000))
    out = arrow_map.append_columns(df, ["id"], ["text"], "n int", lambda text: dict(n=len(text)))
    assert out.agg(F.count("*"), F.sum("n"), F.countDistinct("id")).first() == (1000, 10_000_000, 1000)


def test_arrivals_update_the_index(spark, tmp_path):
    batches = [
        [("r", "a.py", b"def f(): return 1\n", 18), ("s", "s.py", b"y = 1\n", 6)],
        [("r", "a.py", b"def g(): return 1\n", 18), ("r", "b.py", b"def h(): return 1\n", 18)],
    ]
    stream = arrive(spark, str(tmp_path / "in"), batches, "repository_id string, path string, content binary, size bigint")
    run_batches(stream, J.index_arrivals(str(tmp_path / "out"), dimensions=16), folder=str(tmp_path / "out"))
    current = lambda n: store.read_current(spark, str(tmp_path / "out"), n, store.INDEX_TABLES[n])
    assert {(f.repository_id, f.path) for f in current("files").collect()} == {("r", "a.py"), ("r", "b.py"), ("s", "s.py")}
    assert {s.name for s in current("symbols").collect()} == {"g", "h"}
    assert current("vectors").count() == current("code_chunks").count() == 3


def test_limits_across_batches(spark, tmp_path):
    rows = [(i, "u", i * 20) for i in range(12)]
    stream = arrive(spark, str(tmp_path / "in"), [rows[:5], rows[5:8], rows[8:]], "id long, user string, s long")
    out = catch_up(S.limit_requests(stream.withColumn("ts", F.timestamp_seconds("s")), "user", "ts", "id", 2, 60), folder=str(tmp_path / "o"))
    got = {r.id: r.accepted for r in spark.read.parquet(out + "/out").collect()}
    assert [i for i in range(12) if got[i]] == [0, 1, 3, 4, 6, 7, 9, 10]


def test_replies_across_batches(spark, tmp_path):
    first = [(1, 0, "Hello ", False, 0), (1, 1, "wor", False, 1), (2, 0, "cut", False, 0), (3, 0, "  ", False, 0)]
    second = [(1, 2, "ld", False, 2), (1, 3, None, True, 3), (3, 1, None, True, 1)]
    late = [(2, 1, "!", False, 5000), (9, 0, "tick", True, 90000)]
    stream = arrive(spark, str(tmp_path / "in"), [first, second, late[1:], [(9, 1, "t", True, 90001)]],
                    "reply_id long, seq int, token string, is_end boolean, s long")
    tokens = stream.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    out = catch_up(S.assemble_replies(tokens, patience=600), folder=str(tmp_path / "o"))
    got = {r.reply_id: (r.status, r.content) for r in spark.read.parquet(out + "/out").filter("reply_id < 9").collect()}
    assert got == {1: ("COMPLETED", "Hello world"), 2: ("FAILED", None), 3: ("FAILED", None)}


def test_generation_is_shared(spark, tmp_path):
    made = []

    def compute(todo):
        made.append(sorted(r.key for r in todo.collect()))
        return todo.select("key", F.when(F.col("key") != "bad", F.concat(F.lit(f"v{len(made)}:"), "text")).alias("result"))

    batches = [
        [(1, "k", "t", False), (2, "k", "t", False), (3, "bad", "t", False)],
        [(4, "k", "t", False), (5, "bad", "t", False)], [(6, "k", "t", True)],
    ]
    stream = arrive(spark, str(tmp_path / "in"), batches, "request_id int, key string, text string, force boolean")
    run_batches(stream, J.shared_generation(str(tmp_path / "o"), compute), folder=str(tmp_path / "o"))
    got = {r.request_id: (r.result, r.reused) for r in spark.read.parquet(f"{tmp_path}/o/out").collect()}
    assert got[1] == got[2] == ("v1:t", False) and got[4] == ("v1:t", True) and got[6] == ("v3:t", False)
    assert got[3][0] is None and got[5][0] is None
    assert made == [["bad", "k"], ["bad"], ["k"]]


@pytest.mark.parametrize("rows_per_key", [10**6, 30])
def test_limit_batches_carry_over(spark, tmp_path, rows_per_key):
    rng = random.Random(14)
    rows = sorted(((rng.choice(["hot", "hot", "u", "v"]), rng.randint(0, 900)) for _ in range(240)), key=lambda r: r[1])
    rows = [(i, user, s) for i, (user, s) in enumerate(rows)]
    stream = arrive(spark, str(tmp_path / "in"), [rows[:90], rows[90:100], rows[100:]], "id long, user string, s long")
    folder = str(tmp_path / "o")
    handler = J.limit_arrivals(folder, "user", "ts", "id", 3, 60, rows_per_key)
    run_batches(stream.withColumn("ts", F.timestamp_seconds("s")), handler, folder=folder)
    got = {r.id: r.retry_after for r in spark.read.parquet(folder + "/out").collect()}
    logs = {}
    assert got == {i: logs.setdefault(u, SlidingLog(3, 60_000_000)).offer(s * 1_000_000) for i, u, s in rows}


def test_admission_batches_carry_over(spark, tmp_path):
    rng = random.Random(15)
    rows = [(rng.choice("aab"), i, f"k{rng.randint(0, 5)}", f"r{rng.randint(0, 2)}", rng.random() < 0.3, i) for i in range(120)]
    stream = arrive(spark, str(tmp_path / "in"), [rows[:20], rows[20:30], rows[30:]],
                    "owner_id string, repository_id long, source_key string, revision string, failed boolean, created_at long")
    folder = str(tmp_path / "o")
    run_batches(stream, J.admit_arrivals(folder, 4), folder=folder)
    got = {r.repository_id: r.outcome for r in spark.read.parquet(folder + "/out").collect()}
    held, want = {}, {}
    for owner, i, key, revision, failed, _ in rows:
        mine = held.setdefault(owner, set())
        want[i] = "reused" if (key, revision) in mine else "admitted" if len(mine) < 4 else "refused"
        if want[i] == "admitted" and not failed:
            mine.add((key, revision))
    assert got == want
