import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcmill.functions import fixed_values as V
from srcmill.functions import text as X
from srcmill.operators import accounts as A
from srcmill.operators import inventory as N
from srcmill.operators import rate_limits as L
from srcmill.operators import retrieval as R
from srcmill.operators import running as G
from srcmill.operators import scores
from srcmill.operators import snapshots as D
from srcmill.operators import vectors as VE


def test_running_total_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for limit in (None, 700):
        got = {(r.k, r.o): r.running for r in G.running_total(df, "k", "o", "v", width=37, limit=limit).collect()}
        sums, want = {}, {}
        for k, o, v in rows:
            sums[k] = sums.get(k, 0) + v
            if limit is None or sums[k] <= limit:
                want[(k, o)] = sums[k]
        assert got == want


def loop_pack(chunks, reserved, budget):
    used, seen, kept = reserved, set(), []
    for order, content in chunks:
        if not content or content[:100] in seen:
            continue
        seen.add(content[:100])
        if used + len(content) // 4 > budget:
            break
        used += len(content) // 4
        kept.append((order, used))
    return kept


def test_pack_context_against_loop(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for q in range(40):
        reserved = rng.randint(0, 30)
        chunks = [(i, rng.choice(["", "ab", "x" * rng.randint(0, 60), "y" * 99 + rng.choice("ab") * 30, "z" * 120 + str(i)]))
                  for i in range(rng.randint(1, 14))]
        want[q] = loop_pack(chunks, reserved, 120)
        rows += [(q, i, c, reserved) for i, c in chunks]
    df = spark.createDataFrame(rows, "q int, o int, content string, reserved int")
    got = {q: [] for q in want}
    for r in R.pack_context(df, "q", "o", F.col("reserved"), budget=120, width=3).orderBy("q", "o").collect():
        got[r.q].append((r.o, r.used_tokens))
    assert got == want


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("rows, max_pivots, query_block", [(4096, 512, 4096), (20, 512, 7), (20, 3, 1000)])
def test_vectors_around_pivots(spark, scoped, rows, max_pivots, query_block):
    """One and many partitions, tiles of large ones, blocks of queries, against all pairs."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(400, 8)) * rng.uniform(0.1, 3, size=(400, 1))  # any length
    vectors[50:90] = vectors[50]  # a group of copies: ties go by id
    queries = vectors[::9]
    v = spark.createDataFrame([(i, i % 3, [float(x) for x in r]) for i, r in enumerate(vectors)] + [(900, 1, None)], "id long, s int, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", i % 3, [float(x) for x in r]) for i, r in enumerate(queries)] + [("none", 1, None), ("far", 7, [1.0] * 8)],
                              "query_id string, s int, embedding array<double>")
    asked = q if scoped else q.filter("query_id <> 'far'")
    out = VE.vector_search_many(v.repartition(5), asked, 6, "id", "query_id", "s" if scoped else None, rows, max_pivots, query_block).collect()
    assert {r.query_id for r in out} == {f"q{i}" for i in range(len(queries))}
    for i, query in enumerate(queries):
        scored = [(-round(float(query @ r), 12), j) for j, r in enumerate(vectors) if not scoped or j % 3 == i % 3]
        want = [j for _, j in sorted(scored)[:6]]
        assert [r.id for r in sorted((r for r in out if r.query_id == f"q{i}"), key=lambda r: r["rank"])] == want
    assert VE.vector_search_many(v, q.limit(0), 6).count() == 0 and VE.vector_search_many(v.limit(0), asked, 6).count() == 0


def test_partitions_bound_their_vectors(spark):
    """Every vector lies in the nearest pivot's partition, within its radius; clusters keep most partitions out of reach."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 5
    points = np.concatenate([c + rng.normal(size=(60, 16)) * 0.1 for c in centres])
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(points)], "id long, embedding array<double>")
    members, parts = VE.partitioned(v, rows=30)
    parts = {r._pivot: (np.array(r.embedding), r._radius, r._n) for r in parts.collect()}
    rows = members.collect()
    assert sorted(r._id for r in rows) == list(range(len(points))) and len(parts) > 8
    for r in rows:
        own = np.linalg.norm(points[r._id] - parts[r._pivot][0])
        assert own <= parts[r._pivot][1] + 1e-9 and own <= min(np.linalg.norm(points[r._id] - c) for c, _, _ in parts.values()) + 1e-9
    query = points[7]
    bounds = {p: float(query @ c) + np.linalg.norm(query) * radius for p, (c, radius, _) in parts.items()}
    kth = sorted((float(query @ x) for x in points), reverse=True)[4]
    assert sum(b >= kth for b in bounds.values()) < len(parts) / 2
    got = VE.vector_search_many(v, spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, embedding array<double>"), 5, rows=30)
    assert [r.id for r in got.orderBy("rank").collect()] == sorted(range(len(points)), key=lambda j: (-round(float(query @ points[j]), 12), j))[:5]


def test_single_vector_search_equals_batch(spark):
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, "a" if i % 4 else "b", [float(x) for x in rng.normal(size=4)]) for i in range(60)],
                              "id long, language string, embedding array<double>")
    query = [0.5, 0.5, 0.5, 0.5]
    q = spark.createDataFrame([(1, query)], "query_id int, embedding array<double>")
    single = [(r.id, r.score) for r in VE.vector_search(v, query, 9).collect()]
    batch = [(r.id, r.score) for r in VE.vector_search_many(v, q, 9).orderBy("rank").collect()]
    assert single == batch
    assert len(VE.vector_search(v, query, 100, where="language = 'b'").collect()) == 15


WORDS = ["alpha", "beta", "gamma", "the", "in", "delta", "al", "ta", "omega", "abcd"]


def corpus(rng, n):
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    return [(i, "r" if rng.random() < 0.7 else "s", text(rng.randint(0, 3)) or None, rng.choice(["function", "page", None]),
             "src/" + text(1), "Alpha " + text(rng.randint(0, 9))) for i in range(n)]


def brute_ranking(chunks, questions, k, near=None):
    near, out = near or {}, {}
    import re

    for q, repo, text in questions:
        words = set(re.findall(r"\b\w+\b", text.lower()))
        terms, scored = words - set(V.STOP_WORDS), []
        for i, r, symbol, kind, path, content in chunks:
            s, p, c = (symbol or "").lower(), path.lower(), content.lower()
            base = near.get(q, {}).get(i)
            if r != repo or (base is None and not any(len(w) > 3 and (w in s or w in p) for w in words)):
                continue
            score, rank = base if base else (0.3, 99)
            total = score + 0.05 * sum(t in c for t in terms) + 0.1 * sum(t in s for t in terms) + 0.08 * sum(t in p for t in terms)
            scored.append((-round(total + (0.03 if kind in ("function", "method", "class") else 0), 9), rank, i))
        out[q] = [(i, -n) for n, _, i in sorted(scored)[:k]]
    return {q: v for q, v in out.items() if v}


def retrieval_frames(spark, chunks, questions):
    c = spark.createDataFrame(chunks, "id long, repository_id string, symbol_name string, symbol_type string, file_path string, content string")
    q = spark.createDataFrame(questions, "question_id long, repository_id string, question string")
    return c, R.question_terms(q)


def test_keyword_ranking_against_loop(spark):
    rng = random.Random(9)
    chunks = corpus(rng, 150)
    questions = [(q, rng.choice("rs"), " ".join(rng.choice(WORDS) for _ in range(4))) for q in range(25)]
    c, q = retrieval_frames(spark, chunks, questions)
    out = R.rank_keyword_candidates(c.repartition(4), q, 5)
    got = {}
    for r in out.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.id, round(r.final_score, 9)))
    assert got == brute_ranking(chunks, questions, 5)


def test_hybrid_retrieval_against_loop(spark):
    from srcmill.plans.catalog_search import retrieve

    rng = random.Random(10)
    chunks = corpus(rng, 120)
    questions = [(q, "r", " ".join(rng.choice(WORDS) for _ in range(4))) for q in range(12)]
    c, q = retrieval_frames(spark, chunks, questions)
    out = retrieve(c, q, n_initial=10, n_final=6, dimensions=32)
    text = VE.embedding_text(F.col("file_path"), F.col("symbol_name"), F.col("symbol_type"), F.col("content"))
    v = {r.id: np.array(r.embedding, dtype=np.float64) for r in VE.embed(c.withColumn("t", text), "t", 32).collect()}
    w = {r.question_id: np.array(r.embedding, dtype=np.float64) for r in VE.embed(q, "question", 32).collect()}
    near = {}
    for question, vector in w.items():
        order = sorted((-round(float(vector @ v[i]), 12), i) for i, r, *_ in chunks if r == "r")[:10]
        near[question] = {i: (round(-s, 4), rank) for rank, (s, i) in enumerate(order, 1)}
    got = {}
    for r in out.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.id, round(r.final_score, 9)))
    assert got == brute_ranking(chunks, questions, 6, near)


def test_context_text_numbers_and_sources(spark):
    rows = [(1, 1, "a.py", "f", "function", 1, 3, "code one", "python", 0.9), (1, 2, "b.py", None, None, 4, 5, "code two", "python", 0.8)]
    df = spark.createDataFrame(rows, "q int, rank int, file_path string, symbol_name string, symbol_type string, start_line int, "
                                     "end_line int, content string, language string, final_score double")
    r = R.context_text(df, "q", "rank").first()
    assert r.context == ("## Relevant Code\n\n### [1] a.py → f (function) [Lines 1-3]\n```python\ncode one\n```\n\n"
                         "### [2] b.py [Lines 4-5]\n```python\ncode two\n```\n")
    assert [s.file_path for s in r.sources] == ["a.py", "b.py"]


class LoopLimiter:
    def __init__(self, limit, seconds):
        self.limit, self.seconds, self.log = limit, seconds, {}

    def check(self, key, now):
        import math

        kept = [t for t in self.log.get(key, []) if t > now - self.seconds]
        if len(kept) >= self.limit:
            self.log[key] = kept
            return max(1, math.ceil(kept[0] + self.seconds - now))
        self.log[key] = kept + [now]
        return 0


@given(st.lists(st.integers(0, 400), max_size=60), st.integers(1, 4), st.integers(1, 90))
@settings(max_examples=200, deadline=None)
def test_sliding_log(times, limit, seconds):
    log, loop = L.SlidingLog(limit, seconds * 1_000_000), LoopLimiter(limit, seconds)
    for t in sorted(times):
        assert log.offer(t * 1_000_000) == loop.check("k", t)


def test_limiter_clock():
    log = L.SlidingLog(2, 60_000_000)
    assert [log.offer(t * 1_000_000) for t in (0, 1, 2, 60)] == [0, 0, 58, 0]


@pytest.mark.parametrize("rows_per_key", [10**6, 60])
def test_rate_limit_in_slices(spark, rows_per_key):
    """A third of all requests comes from one key; the history is cut into slices with a hand-over."""
    rng = random.Random(11)
    requests = [(i, "hot" if i % 3 == 0 else f"u{rng.randint(0, 5)}", rng.randint(0, 3000)) for i in range(900)]
    df = spark.createDataFrame(requests, "id long, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.retry_after for r in L.replay_limits(df, "user", "ts", "id", 3, 60, rows_per_key).collect()}
    loop = LoopLimiter(3, 60)
    assert got == {i: loop.check(user, s) for i, user, s in sorted(requests, key=lambda r: (r[2], r[0]))}


def ledger(spark, rows):
    return spark.createDataFrame(rows, "owner_id string, source_key string, revision string, at long, failed boolean")


def test_admission_rules(spark):
    rows = [("a", f"k{i}", "r1", i, False) for i in range(11)] + [("a", "k0", "r1", 50, False), ("a", "k99", "r1", 51, False)]
    rows += [("b", "k0", "r1", 1, True), ("b", "k0", "r1", 2, False), ("b", "k0", "r2", 3, False)]
    out = {(r.owner_id, r["at"]): r.outcome for r in A.replay_admissions(ledger(spark, rows)).collect()}
    assert [out[("a", i)] for i in range(11)] == ["admitted"] * 10 + ["refused"]
    assert (out[("a", 50)], out[("a", 51)]) == ("reused", "refused")
    assert [out[("b", i)] for i in (1, 2, 3)] == ["admitted"] * 3


def loop_admissions(rows, limit):
    held, out = {}, {}
    for owner, key, revision, at, failed in sorted(rows, key=lambda r: r[3]):
        mine = held.setdefault(owner, set())
        out[(owner, at)] = "reused" if (key, revision) in mine else "admitted" if len(mine) < limit else "refused"
        if out[(owner, at)] == "admitted" and not failed:
            mine.add((key, revision))
    return out


def test_admissions_against_loop(spark):
    rng = random.Random(12)
    rows = [(rng.choice("abc"), f"k{rng.randint(0, 5)}", f"r{rng.randint(0, 2)}", i, rng.random() < 0.3) for i in range(300)]
    got = {(r.owner_id, r["at"]): r.outcome for r in A.replay_admissions(ledger(spark, rows), limit=4).collect()}
    assert got == loop_admissions(rows, 4)


def test_seeding_twice_changes_nothing(spark):
    repos = spark.createDataFrame(
        [("1", "u", "github", "https://GitHub.com/O/R.git/", "READY"), ("2", "u", "zip", None, "FAILED"),
         ("3", "u", "zip", None, "UPLOADING"), ("4", None, "zip", None, "READY")],
        "id string, owner_id string, source_type string, source_url string, status string",
    ).withColumn("created_at", F.lit(None).cast("timestamp"))
    empty = spark.createDataFrame([], "repository_id string, owner_id string, source_key string, revision string, status string, created_at timestamp")
    once = A.seed_ledger(repos, empty)
    assert {(r.repository_id, r.source_key) for r in once.collect()} == {("1", "https://github.com/o/r"), ("2", "legacy:2"), ("3", "legacy:3")}
    assert A.seed_ledger(repos, once).count() == 3
    u = A.usage(once).first()
    assert (u.used, u.reserved, u.remaining) == (1, 1, 8)


def test_export_isolation_and_cascade(spark):
    repos = spark.createDataFrame([("r1", "A"), ("r2", "B"), ("r3", None)], "id string, owner_id string")
    tables = dict(
        repositories=repos,
        files=spark.createDataFrame([("f1", "r1"), ("f2", "r2"), ("f3", "r3")], "id string, repository_id string"),
        symbols=spark.createDataFrame([("f1", "x"), ("f2", "y"), ("f3", "z")], "file_id string, name string"),
        conversations=spark.createDataFrame([("c1", "r1"), ("c2", "r2")], "id string, repository_id string"),
        messages=spark.createDataFrame([(str(i), "c1") for i in range(106)] + [("x", "c2")], "id string, conversation_id string"),
        analysis_admissions=spark.createDataFrame([("gone", "A"), ("r2", "B")], "repository_id string, owner_id string"),
    )
    mine = A.owned_tables(tables, "A")
    assert {n: d.count() for n, d in mine.items()} == dict(
        repositories=1, files=1, symbols=1, conversations=1, messages=106, usage_history=1
    )
    rest = A.delete_account(tables, "A")
    assert {n: d.count() for n, d in rest.items()} == dict(
        repositories=2, files=2, symbols=2, conversations=1, messages=1, analysis_admissions=1
    )


def brute_dependents(imports, paths, scanned):
    out = {}
    for seq, path in paths:
        out[path] = sum(m.replace(".", "/") in path and (not scanned or s <= seq) for s, m in imports)
    return out


@pytest.mark.parametrize("mode", ["complete", "as_scanned"])
def test_import_dependents_against_loop(spark, mode):
    rng = random.Random(13)
    names = ["a", "os", "api", "core", "util", "core/util", "x"]
    paths = [(i, "/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + f"{i}.py") for i in range(60)]
    modules = ["", "os", "a", "api", "core.util", "util", "nothing", "./x", "e/u", "x1"]
    imports = [(rng.randint(0, 59), rng.choice(modules)) for _ in range(300)]
    i = spark.createDataFrame([("r", s, m) for s, m in imports], "repository_id string, seq long, module string")
    p = spark.createDataFrame([("r", s, x) for s, x in paths], "repository_id string, seq long, path string")
    got = {r.path: r.dependents for r in N.import_dependents(i, p, mode).collect()}
    assert got == brute_dependents(imports, paths, mode == "as_scanned")


def test_opened_paths_are_not_sent_to_all_tasks(spark, tmp_path):
    """A small file opens into many grams; only the join with the needles' grams may be by broadcast."""
    rows = [("r", f"core/util{i}.py", f"util{i}") for i in range(50)]
    spark.createDataFrame(rows, "repository_id string, path string, needle string").write.parquet(f"{tmp_path}/rows")
    files = spark.read.parquet(f"{tmp_path}/rows")
    pairs = N.substring_pairs(files.select("repository_id", "needle"), "needle", files.select("repository_id", "path"), "path", ["repository_id"])
    plan = pairs._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert "SortMergeJoin" in next(line for line in plan if "Join" in line)
    assert pairs.count() == 50 + 4 * 10  # util1 is also part of util10 to util19, and so on


def test_cached_vectors_compute_once(spark):
    seen = []

    def compute(missing):
        seen.append(sorted(r.text for r in missing.collect()))
        return missing.select("text", F.array(F.length("text").cast("float")).alias("embedding"))

    none = spark.createDataFrame([], "text string, embedding array<float>")
    first = D.with_cached_vectors(spark.createDataFrame([("first",), ("first",), ("second",)], "text string"), none, "text", compute)
    assert first.count() == 3 and seen[0] == ["first", "second"]
    cache = first.select("text", "embedding").distinct()
    again = D.with_cached_vectors(spark.createDataFrame([("second",), ("first",)], "text string"), cache, "text", compute)
    assert again.filter("reused").count() == 2 and seen[1] == []
    broken = cache.withColumn("embedding", F.array(F.lit(float("nan")).cast("float")))
    assert D.with_cached_vectors(spark.createDataFrame([("first",)], "text string"), broken, "text", compute).filter("not reused").count() == 1


def test_cache_bounds(spark):
    rows = spark.createDataFrame([("r", i, 10) for i in range(5)], "repository_id string, mtime long, bytes long")
    kept = lambda **o: sorted(r.mtime for r in D.evict_cache(rows, now=10, **o).collect())
    assert kept(max_entries=2) == [3, 4]
    assert kept(max_bytes=35) == [2, 3, 4]
    assert kept(ttl=-1) == []
    assert kept(max_entry=9) == []


def test_stale_runs(spark):
    jobs = spark.createDataFrame([("r1", "ANALYSIS", "COMPLETED"), ("r1", "CHAT:1", "COMPLETED"), ("r2", "ANALYSIS", "COMPLETED")],
                                 "repository_id string, job_type string, status string")
    changed = spark.createDataFrame([("r1",)], "repository_id string")
    assert [r.status for r in D.invalidate_runs(jobs, changed).orderBy("repository_id", "job_type").collect()] == ["STALE", "COMPLETED", "COMPLETED"]


def test_scan_key_ignores_order_but_not_content(spark):
    rows = [(str(i), "r", f"p{i}", "python", f"h{i}") for i in range(30)]
    key = lambda data: scores.scan_keys(spark.createDataFrame(data, "id string, repository_id string, path string, language string, hash string")).first().scan_key
    assert key(rows) == key(rows[::-1])
    assert key(rows) != key(rows[:-1] + [("29", "r", "p29", "python", "other")])


def test_language_line(spark):
    df = spark.createDataFrame([({"go": 1, "python": 3, "c": 1},)], "m map<string,long>")
    assert df.select(X.language_line(F.col("m"))).first()[0] == "python (3 files), c (1 files), go (1 files)"
