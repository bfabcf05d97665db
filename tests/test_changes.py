"""The store of changes: what a commit writes, what readers see, folding, removal, repeated and failed attempts."""

import os

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from srcmill.plans import refresh
from srcmill.sources import changes

ROWS = "file string, line int, text string"


@pytest.fixture
def keys(spark):
    return {"lines": F.col("file"), "notes": F.col("file")}


def put(spark, folder, number, replaced, lines, keys, notes=()):
    frames = {"lines": spark.createDataFrame(lines, ROWS), "notes": spark.createDataFrame(list(notes), ROWS)}
    return changes.commit(spark, folder, number, spark.createDataFrame([(r,) for r in replaced], "key string"), frames, keys)


def seen(spark, folder, name="lines", version=None):
    return sorted((r["file"], r["line"], r["text"]) for r in changes.read(spark, folder, name, ROWS, version).collect())


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_commits(spark, tmp_path, keys):
    folder = str(tmp_path / "store")
    assert seen(spark, folder) == [] and changes.manifest(spark, folder) == (0, None, [])
    put(spark, folder, 0, [], [("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], keys, [("a", 1, "note")])
    put(spark, folder, 3, ["a", "unknown"], [("a", 1, "new"), ("c", 1, "z")], keys)  # fewer rows than before
    assert seen(spark, folder) == [("a", 1, "new"), ("b", 1, None), ("c", 1, "z")] and seen(spark, folder, "notes") == []
    assert put(spark, folder, 3, ["a"], [("a", 9, "again")], keys) == 2 and len(seen(spark, folder)) == 3  # a repeated attempt
    put(spark, folder, 4, ["b", "b"], [], keys)  # a removal
    put(spark, folder, 5, [], [("b", 7, "back"), ("b", 7, "back")], keys)
    assert seen(spark, folder) == [("a", 1, "new"), ("b", 7, "back"), ("b", 7, "back"), ("c", 1, "z")]
    assert seen(spark, folder, version=1) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)]
    assert sorted(tuple(r) for r in changes.versions(spark, folder).collect()) == [(1, 0), (2, 3), (3, 4), (4, 5)]
    put(spark, folder, 6, [], [], keys)
    assert changes.manifest(spark, folder)[0] == 5


@pytest.mark.parametrize("sent", [0, 500_000])
def test_folding(spark, tmp_path, keys, monkeypatch, sent):
    """Rows in force survive folding, merging and removal, whichever way the changed keys travel."""
    monkeypatch.setattr(changes, "SENT_KEYS", sent)
    folder, want, shapes = str(tmp_path / "store"), {}, []
    for n in range(12):
        fresh = {f"f{i}": [(f"f{i}", j, f"{n}") for j in range(i % 3 + 1)] for i in (range(120) if n == 0 else range(n * 5, n * 5 + 4))}
        gone = [f"f{n}"] if n else []
        put(spark, folder, n, [*fresh, *gone], [r for rows in fresh.values() for r in rows], keys)
        want = {**want, **fresh}
        for g in set(gone) - set(fresh):
            want.pop(g, None)
        if n in (0, 7, 11):
            before = changes.manifest(spark, folder)[0]
            after = changes.compact(spark, folder, {"lines": ROWS}, max_segments=4, share=0.5)
            assert after == before + 1 and changes.compact(spark, folder, {"lines": ROWS}, 4, 0.5) == after
            shapes.append(sorted(s["is_base"] for s in changes.manifest(spark, folder)[2] if s["name"] == "lines"))
        if n in (0, 6, 7, 10, 11):
            assert seen(spark, folder) == sorted(r for rows in want.values() for r in rows)
    assert shapes == [[True], [False, True], [True]]  # folded, merged beside the base, folded
    stray = tmp_path / "store" / "segments" / "lines-of-a-failed-attempt"
    stray.mkdir()
    assert changes.vacuum(spark, folder) > 10 and not stray.exists()
    assert seen(spark, folder) == sorted(r for rows in want.values() for r in rows)
    kept = {s["segment"] for s in changes.manifest(spark, folder)[2]}
    assert set(os.listdir(f"{folder}/segments")) == kept and len(os.listdir(f"{folder}/manifests")) == 1
    assert changes.vacuum(spark, folder) == 0


def test_small_change_writes_little(spark, tmp_path, keys):
    folder = str(tmp_path / "store")
    put(spark, folder, 0, [], [(f"f{i}", j, os.urandom(16).hex()) for i in range(2000) for j in range(20)], keys)
    whole = size(folder)
    put(spark, folder, 1, ["f7"], [("f7", 1, "new")], keys)
    assert size(folder) - whole < whole / 50
    plan = changes.read(spark, folder, "lines", ROWS)._jdf.queryExecution().toString()
    changes.compact(spark, folder, {"lines": ROWS})
    folded = changes.read(spark, folder, "lines", ROWS).count()
    assert folded == 2000 * 20 - 19 and "Window" in plan


def test_failed_commit(spark, tmp_path, keys):
    """Tables of a commit appear together: one that fails half way leaves nothing to see."""
    folder = str(tmp_path / "store")
    put(spark, folder, 0, [], [("a", 1, "x")], keys, [("a", 1, "n")])
    with pytest.raises(SparkRuntimeException):
        put(spark, folder, 1, ["a"], [("a", 1, "y")], keys, [(None, 1, "no key")])
    assert seen(spark, folder) == [("a", 1, "x")] and seen(spark, folder, "notes") == [("a", 1, "n")]
    put(spark, folder, 1, ["a"], [("a", 1, "y")], keys)
    assert seen(spark, folder) == [("a", 1, "y")]


def test_changed_files(spark, tmp_path):
    """Arrivals, equal copies, removals and files that have become unfit, against the stored hashes."""
    from srcmill.sources import store

    def tree(files):
        rows = [("r", path, bytearray(text.encode()), len(text)) for path, text in files.items()]
        return spark.createDataFrame(rows, "repository_id string, path string, content binary, size long")

    folder = str(tmp_path / "store")

    def arrive(number, files, gone=()):
        stored = changes.read(spark, folder, "files", store.INDEX_TABLES["files"])
        vanished = spark.createDataFrame([("r", g) for g in gone], "repository_id string, path string")
        found = refresh.changed_rows(stored, tree(files), vanished, dimensions=8)
        counts = [tuple(r)[1:] for r in found["counts"].collect()]
        refresh.commit_changes(spark, folder, number, found)
        read = lambda name: changes.read(spark, folder, name, store.INDEX_TABLES[name])
        assert read("vectors").count() == read("code_chunks").count()
        return counts, sorted(r["path"] for r in read("files").collect()), sorted(r["name"] for r in read("symbols").collect())

    one, two = "def one():\n    return 1\n\n\n", "def two():\n    return 2\n\n\n"
    assert arrive(0, {"a.py": one, "b.py": two, "c.go": "package c\n"}) == ([(0, 0, 3, 0)], ["a.py", "b.py", "c.go"], ["one", "two"])
    assert arrive(1, {"a.py": one, "b.py": one + two}) == ([(1, 1, 0, 0)], ["a.py", "b.py", "c.go"], ["one", "one", "two"])
    assert arrive(2, {"b.py": "\0"}, ["a.py"]) == ([(0, 0, 0, 2)], ["c.go"], [])  # binary now; gone
    assert arrive(3, {"a.py": two}, ["a.py", "nowhere.py"]) == ([], ["c.go"], [])
