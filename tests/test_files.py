import io
import random
import stat
import string
import zipfile

import pytest
from pyspark.sql import functions as F

from srcmill.functions import paths as P
from srcmill.functions import text as X
from srcmill.sources import archives, store, tree


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_selection_and_language(spark):
    cases = {
        "a/main.py": (True, "python"), "sub/A.C": (True, "cpp"), "x.c": (True, "c"), "web/x.min.js": (False, "javascript"),
        "types.d.ts": (False, "typescript"), "Node_Modules/a.py": (False, "python"), "Dockerfile": (True, "unknown"),
        ".env": (False, "unknown"), ".env.example": (True, "unknown"), "docs/README.md": (True, "markdown"),
        "docs/other.md": (False, "markdown"), "demo.ipynb": (True, "notebook"), "config.json": (True, "json"),
        "debug": (False, "unknown"), "k.tpp": (True, "cpp"),
    }
    assert column(spark, list(cases), P.should_process) == [c[0] for c in cases.values()]
    assert column(spark, list(cases), P.language_of) == [c[1] for c in cases.values()]


def test_stem_removes_every_listed_part(spark):
    assert column(spark, ["src/a.jsx", "App.ts", "x.py.py"], P.stem) == ["ax", "app", "x"]


def test_size_limits(spark):
    assert column(spark, ["demo.ipynb", "a.py"], P.size_limit) == [10 * 1024 * 1024, 1024 * 1024]


def test_binary_probe_and_decoding(spark):
    values = [b"text", b"a\x00b", b"x" * 8192 + b"\x00", None]
    assert column(spark, values, P.is_binary, "binary") == [False, True, False, True]
    assert column(spark, [b"a\xffb", "é".encode()], X.decode_utf8, "binary") == ["ab", "é"]
    assert column(spark, [b"a\xffb"], lambda c: X.decode_utf8(c, "replace"), "binary") == ["a\ufffdb"]


LINE_TEXTS = ["", "a", "a\n", "a\r\nb", "a\n\n", "\n", "a\x0bb\x0cc\x1cd\u2028e\x85f", "a\rb\r", "x\u2029"]


def test_lines(spark):
    assert column(spark, LINE_TEXTS, X.split_lines) == [t.splitlines() for t in LINE_TEXTS]
    assert column(spark, LINE_TEXTS, X.count_lines) == [len(t.splitlines()) for t in LINE_TEXTS]


def random_names(letters, lengths, n=6):
    r = random.Random(len(letters))
    return ["".join(r.choice(letters) for _ in range(r.choice(lengths))) for _ in range(n)]


PART = string.ascii_lowercase + string.digits


def test_repository_urls_in_every_form(spark):
    """Scheme and host in any case, port 443, blanks around, a closing slash and '.git' make no difference."""
    for owner, name in zip(random_names(PART, [1, 5, 30]), random_names(PART + "_.-", [8, 20], 6)):
        name = f"{name}x"  # ends in neither '.git' nor a dot
        want = f"https://github.com/{owner}/{name}"
        forms = [f"{start}/{owner.upper()}/{name}{end}" for start in ("https://github.com", "HTTPS://GITHUB.com:443") for end in ("", "/", ".git", ".git/", "?", "#")]
        assert column(spark, [*forms, f"  {want} "], P.normalize_repository_url) == [want] * 13
        kept = f"https://gitlab.com/{owner}/Sub/{name.title()}"
        assert column(spark, [kept, f"{kept}/"], P.normalize_repository_url) == [kept] * 2


def test_repository_urls_by_rule(spark):
    """Each rule just inside and just outside."""
    url = "https://{host}/{owner}/{name}".format
    good = dict(host="github.com", owner="abc", name="tool")
    inside = [dict(name="n" * 100), dict(host="gitlab.com", name="n" * 101), dict(owner="_a"), dict(name=".x"), dict(name="a%2Eb"), dict(host="gitlab.com", owner="a/b/c")]
    outside = [
        dict(name="n" * 101), dict(owner="-a"), dict(owner=".a"), dict(host="gitlab.com", owner="-a"), dict(host="gitlab.com", owner="a."), dict(host="gitlab.com", name="a.atom"),
        dict(name="."), dict(name="%2E%2E"), dict(name=".git"), dict(name="a%2Fb"), dict(owner="a/b"), dict(owner=""), dict(name="a?q=1"), dict(name="a#f"), dict(name="a//"),
        dict(host="github.com:444"), dict(host="github.com:"), dict(host="x@github.com"), dict(host="github.org"), dict(host="a.github.com"), dict(name="a\tb"),
    ]
    outside += [dict(name=f"a{c}b") for c in string.printable + "é" if c not in string.ascii_letters + string.digits + "_.-/?#%"]
    assert None not in column(spark, [url(**good | change) for change in inside], P.normalize_repository_url)
    assert column(spark, [url(**good | change) for change in outside], P.normalize_repository_url) == [None] * len(outside)
    rest = ["abc/tool", "http://github.com/abc/tool", "https://github.com", "", None, "https://github.com/abc/" + " " * 4096 + "tool"]
    assert column(spark, rest, P.normalize_repository_url) == [None] * len(rest)


def test_sound_json(spark):
    cases = {'{"a":1}': True, '{"a":1}}': False, "1,2": False, "{": False, '{"a":1,"a":2}': False, "": False, "[1] [2]": False,
             "1} {2": False, '"x"': True}
    assert column(spark, list(cases), X.sound_json) == list(cases.values())


def make_zip(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    link = zipfile.ZipInfo("link")
    link.external_attr = (stat.S_IFLNK | 0o777) << 16
    files = {
        "good": make_zip(("sample.py", "x = 1\n"), ("web/a.ts", "export const a = 1\n")),
        "climbing": make_zip(("../evil.py", "x")), "linked": make_zip((link, "target")),
        "double": make_zip(("A.py", "1"), ("a.py", "2")), "hidden": make_zip(("x/a.py", "1"), ("x/.//a.py", "2")), "large": make_zip(("b.py", "x" * 5000)),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    (tmp_path / "torn.zip").write_bytes(make_zip(("a.py", "x" * 500))[:-30])
    (tmp_path / "not.zip").write_bytes(b"plain text")
    bad = bytearray(make_zip(("a.py", "y" * 500), ("b.py", "fine")))
    bad[40] ^= 0xFF  # inside the first member
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "bad.zip").write_bytes(bytes(bad))
    verdicts, contents = archives.ingest_archives(spark, str(tmp_path), max_bytes=1000)
    assert {r.archive: r.verdict for r in verdicts.collect()} == {
        "good": "accepted", "climbing": "unsafe entry", "linked": "unsafe entry", "double": "duplicate path", "hidden": "duplicate path", "large": "too large",
        "torn": archives.UNREADABLE, "not": archives.UNREADABLE, "bad": "accepted",
    }
    rows = {(r.repository_id, r.path): (r.content and bytes(r.content), r.problem) for r in contents.collect()}
    assert rows == {
        ("good", "sample.py"): (b"x = 1\n", None), ("good", "web/a.ts"): (b"export const a = 1\n", None),
        ("bad", "a.py"): (None, archives.DAMAGED), ("bad", "b.py"): (b"fine", None),
    }
    assert archives.list_archives(spark, str(tmp_path / "below")).count() == 1


def test_members_by_range(spark, tmp_path):
    """One archive is read by many tasks; a member that unpacks to more than it declares is a row with a problem."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(50):
            z.writestr(zipfile.ZipInfo(f"f{i}.py"), f"{i}" * 3000, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    members = archives.archive_members(archives.list_archives(spark, str(tmp_path)))
    name = F.col("member")
    lying = members.withColumns({"size": F.when(name == "f3.py", 10).otherwise(F.col("size")), "method": F.when(name == "f4.py", 12).otherwise(F.col("method"))})
    rows = archives.read_members(lying, task_bytes=10_000).withColumn("task", F.spark_partition_id()).collect()
    assert {r.path: r.problem for r in rows if r.problem} == {"f3.py": archives.OVERSIZED, "f4.py": archives.UNSUPPORTED}
    assert all(bytes(r.content) == (r.path[1:-3] * 3000).encode() for r in rows if not r.problem) and len(rows) == 50
    assert len({r.task for r in rows}) > 8
    assert archives.read_members(members.limit(0)).count() == 0


def test_read_tree(spark, tmp_path):
    files = {
        "r1/src/a b.py": b"x\n", "r1/build/b.py": b"y", "r1/build/deep/c.py": b"y", "r1/out.bin": b"1", "r2/c+d.js": b"\x00", "r2/big.py": b"#" * (1 << 20),
        "r2/bigger.py": b"#" * ((1 << 20) + 1), "r2/a/é%20.py": b"",
    }
    for path, data in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / "stray.py").write_bytes(b"")
    (tmp_path / "r2" / "loop").symlink_to(tmp_path / "r2")
    rows, excluded = tree.source_tree(spark, str(tmp_path))
    assert {(r.path, r.language) for r in tree.select_files(rows).collect()} == {("src/a b.py", "python"), ("big.py", "python"), ("a/é%20.py", "python")}
    assert all(bytes(r.content) == files[f"{r.repository_id}/{r.path}"] for r in rows.collect())
    assert {(r.path, r.reason) for r in excluded.collect()} == {
        ("build/", "pruned folder"), ("out.bin", "unsupported type"), ("c+d.js", "binary content"), ("bigger.py", "too large")
    }
    gone = spark.createDataFrame([("r1", "nowhere.py", 3)], "repository_id string, path string, size long")
    assert [r.reason for r in tree.excluded_files(tree.with_content(gone, str(tmp_path))).collect()] == ["unreadable"]
    climbing = spark.createDataFrame([("r1", "../x.py", bytearray(b""))], "repository_id string, path string, content binary")
    with pytest.raises(Exception, match="not below"):
        tree.write_source_tree(climbing, str(tmp_path)).collect()


def test_export_refuses_instead_of_truncating(spark, tmp_path):
    tables = {
        "messages": spark.createDataFrame([(str(i), "c", "user", "hi", "secret") for i in range(6)],
                                          "id string, conversation_id string, role string, content string, private string"),
        "usage_history": spark.createDataFrame([("r", "READY", "o")], "repository_id string, status string, owner_id string"),
    }
    shown = store.export_tables(tables)
    assert shown["messages"].columns == ["id", "conversation_id", "role", "content"]
    with pytest.raises(ValueError, match="nothing was written"):
        store.write_export(shown, str(tmp_path / "x"), max_rows=5)
    assert not (tmp_path / "x").exists()
    store.write_export(shown, str(tmp_path / "y"))
    manifest = {r.table_name: r.row_count for r in spark.read.json(str(tmp_path / "y" / "manifest")).collect()}
    assert manifest == {"messages": 6, "usage_history": 1}


def test_export_of_stored_tables(spark):
    """The engine's own tables by their public names and columns, with ids where rows have none."""
    from srcmill.schemas import TABLES

    rows = {name: spark.createDataFrame([], TABLES[name]) for name in TABLES}
    rows["repository_jobs"] = spark.createDataFrame(
        [("1", "r", "ANALYSIS", ("3", 5, 70)), ("2", "r", "CHAT:x", None)],
        "id string, repository_id string, job_type string, coverage struct<score_version:string,scanned_files:bigint,scanned_loc:bigint>",
    )
    rows["symbols"] = spark.createDataFrame([("r", "f", "a", "function", 1), ("r", "f", "a", "function", 9)], "repository_id string, file_id string, name string, type string, start_line int")
    shown = store.export_tables(rows)
    assert {"code_chunks", "vectors", "repository_jobs", "account_deletions"}.isdisjoint(shown)
    assert [(r.id, r.coverage) for r in shown["analysis_runs"].collect()] == [("1", {"scanned_files": "5", "scanned_loc": "70"})]
    assert len({r.id for r in shown["symbols"].collect()}) == 2 and "id" in shown["analysis_issues"].columns and "content" in shown["summaries"].columns


def test_vector_rows_use_blanks(spark):
    chunk = spark.createDataFrame(
        [("1", "r", "a.py", None, None, None, 1, 2, "x", [1.0])],
        "id string, repository_id string, file_path string, symbol_name string, symbol_type string, language string, "
        "start_line int, end_line int, content string, embedding array<float>",
    )
    row = store.vector_rows(chunk).first()
    assert (row.symbol_name, row.symbol_type, row.language, row.document) == ("", "", "", "x")
