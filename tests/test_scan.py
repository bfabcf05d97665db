import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from srcmill.functions import fixed_values as V
from srcmill.functions import text as X
from srcmill.operators import chunks as C
from srcmill.operators import code_scan as S
from srcmill.operators import documents as D
from srcmill.operators import js_outline as J
from srcmill.operators import pyfacts
from srcmill.operators import scores as R
from srcmill.plans import scan as plan

SAFE = """import os
import hashlib
from subprocess import Popen as start, check_output
from jose import jwt as tokens
# password = 'only a remark'
note = "pwd='inside a text'"
start(['ls', folder])
check_output(line, shell=False)
tokens.encode(claims, secret, algorithm='RS256')
hashlib.sha1(blob, usedforsecurity=False)
db.execute("DELETE FROM jobs WHERE id = ?", [job])
db.execute("plain" + tail)
auth_token = '<token>'
"""
RISKY = SAFE + """check_output('ls ' + folder, shell=True)
db.execute("DELETE FROM jobs WHERE id = {}".format(job))
hashlib.new('MD5', blob)
auth_token = 'f81d4fae7dec'
"""
NESTED = "def table(rows):\n    def grade(n):\n" + "".join(f"        while n < {i}: n += {i}\n" for i in range(1, 12)) + "        return n\n    return [grade(r) for r in rows]\n"
CHAIN = "def size(n):\n    if n < 1: return 'none'\n" + "".join(f"    elif n < {10 ** i}: return '{i} digits'\n" for i in range(1, 8))
DEEP = "def f(x):\n" + "".join("    " * (i + 1) + "if x:\n" for i in range(7)) + "    " * 8 + "pass\n"


def python_findings(spark, sources):
    rows = spark.createDataFrame(list(sources.items()), "path string, text string")
    found = S.explode_findings(S.with_python_findings(rows, ["path"]), ["path"]).collect()
    return {p: [f for f in found if f.path == p] for p in sources}


def test_python_rules(spark):
    found = python_findings(spark, {"safe": SAFE, "risky": RISKY, "nested": NESTED, "chain": CHAIN, "deep": DEEP})
    security = lambda p: sorted(f.issue_type for f in found[p] if f.issue_type in R.HEALTH_RULES)
    assert security("safe") == []
    assert security("risky") == ["COMMAND_INJECTION", "HARDCODED_SECRET", "SQL_INJECTION", "WEAK_HASH_MD5"]
    assert [(f.issue_type, f.line, "'grade'" in f.message) for f in found["nested"]] == [("HIGH_COMPLEXITY", 2, True)]
    assert "DEEP_NESTING" not in [f.issue_type for f in found["chain"]]
    assert [(f.issue_type, f.severity) for f in found["deep"]] == [("DEEP_NESTING", "HIGH")]


def test_python_smells(spark):
    source = "import os, sys as system\nfrom a import b, c\nfrom __future__ import annotations\nc()\n" \
             "def todo():\n    pass\nclass K:\n    def __init__(self): pass\n    def doc(self):\n        'x'\n" \
             "print(1)  # FIXME soon\n"
    found = python_findings(spark, {"s": source})["s"]
    assert sorted((f.issue_type, f.line) for f in found) == [
        ("DEBUG_PRINT", 11), ("EMPTY_FUNCTION", 5), ("EMPTY_FUNCTION", 9), ("TECHNICAL_DEBT_FIXME", 11),
        ("UNUSED_IMPORT", 1), ("UNUSED_IMPORT", 1), ("UNUSED_IMPORT", 2), ("UNUSED_IMPORT", 3),
    ]


def test_size_rules(spark):
    long = "def f(a, b, c, d, e, g):\n" + "    x = 1\n" * 101
    wide = "class K:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(16)) + "    y = 1\n" * 200
    found = python_findings(spark, {"long": long, "wide": wide})
    assert {(f.issue_type, f.severity) for f in found["long"]} == {("LONG_FUNCTION", "HIGH"), ("TOO_MANY_PARAMS", "MEDIUM")}
    assert {f.issue_type for f in found["wide"]} == {"LARGE_CLASS", "TOO_MANY_METHODS"}


def test_outline_lists_direct_members_only():
    facts = pyfacts.source_facts(
        "class A:\n    'doc'\n    async def m(self, *a, **k):\n        def inner(): pass\n    class B:\n        def n(self): pass\n"
        "if True:\n    def hidden(): pass\n@x.y\ndef f(a): return a and b or c\n"
    )
    symbols = pyfacts.outline(facts)["symbols"]
    assert [(s["name"], s["type"], s["parent_name"]) for s in symbols] == [
        ("A", "class", None), ("m", "method", "A"), ("B", "class", "A"), ("n", "method", "B"), ("f", "function", None)
    ]
    assert symbols[1]["signature"] == "async def m(self, *a, **k)" and symbols[0]["docstring"] == "doc"
    assert symbols[4]["complexity"] == 3.0
    chained = pyfacts.outline(pyfacts.source_facts("@a.b.c\ndef f(): pass\n"))  # a file isn't lost for a decorator
    assert chained["error"] is None and [s["name"] for s in chained["symbols"]] == ["f"]


def naive_own_complexity(node):
    total = 1
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            continue
        total += isinstance(child, (ast.If, ast.IfExp, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.comprehension))
        total += len(child.values) - 1 if isinstance(child, ast.BoolOp) else 0
        total += naive_own_complexity(child) - 1
    return total


def test_complexity_on_library_sources():
    import argparse
    import inspect
    import textwrap

    for module in (argparse, inspect, textwrap):
        source = open(module.__file__).read()
        want = sorted(
            (n.name, n.lineno, naive_own_complexity(n)) for n in ast.walk(ast.parse(source))
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))
        )
        facts = pyfacts.source_facts(source)
        assert want == sorted((c["name"], c["line"], c["branches_own"]) for c in facts["callables"] if c["kind"] != "class")


def test_script_rules(spark):
    text = "/* start\npassword = 'secret1'\n*/ token = 'after-the-end'\nexport const db_token: string = \"abcd1234\"; // x\n" \
           "// api_key = 'commented'\npwd = 'abcd'\nsecret = '${value}'\nlet h = createHash( 'MD5' )\npassword = '<here>'\n"
    rows = spark.createDataFrame([("a.ts", text, "typescript")], "path string, text string, language string")
    found = S.explode_findings(S.with_script_findings(rows), ["path"]).collect()
    assert sorted((f.line, f.issue_type) for f in found) == [
        (4, "HARDCODED_SECRET"), (6, "HARDCODED_PASSWORD"), (8, "WEAK_HASH_MD5")
    ]


def loop_comment_lines(lines):
    inside, out = False, []
    for i, line in enumerate(lines):
        stripped = line.strip()
        if inside or stripped.startswith("/*"):
            inside = "*/" not in stripped
            out.append(i)
    return out


def test_comment_spans_against_loop(spark):
    rng = random.Random(1)
    pieces = ["/*", "*/", "x = 1", "  /* a */", "b */ c", "/*/", "d /* e"]
    cases = [[rng.choice(pieces) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, lines array<string>")
    for r in rows.select("lines", S.comment_spans(F.col("lines")).alias("s")).collect():
        covered = sorted({n for s in r.s for n in range(s.a, s.b + 1) if n < len(r.lines)})
        assert covered == loop_comment_lines(r.lines), r.lines


def loop_block_end(lines, start):
    depth = 0
    for i in range(start - 1, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        if depth <= 0 and i > start - 1:
            return i + 1
    return len(lines)


def test_block_end_against_loop(spark):
    rng = random.Random(2)
    cases = []
    for _ in range(120):
        lines = [rng.choice(["{", "}", "a", "{{", "}}", "{}"]) for _ in range(rng.randint(1, 160))]
        cases.append((lines, rng.randint(1, len(lines))))
    rows = spark.createDataFrame(cases, "lines array<string>, start int")
    net = F.transform("lines", lambda t: (X.occurrences(t, "{") - X.occurrences(t, "}")).cast("int"))
    out = rows.withColumn("net", net).select("lines", "start", J.block_end(F.col("net"), F.col("start"), F.size("lines")).alias("e"))
    for r in out.collect():
        assert r.e == loop_block_end(r.lines, r.start)


def test_script_outline(spark):
    text = "import a, { b } from './a'\nconst c = require('c')\nexport default class Foo {\n}\nexport async function go(x,\n  y) {\n" \
           "  if (x&&y) return x ? 1 : 2\n}\nconst f = async (z) => {\n}\n  function indented() {}\n"
    rows = spark.createDataFrame([(text,)], "text string")
    r = J.with_js_outline(rows).first()
    assert [(i.module, i.line) for i in r.imports] == [("./a", 1), ("c", 2)]
    assert [(s.name, s.type, s.start_line, s.end_line, s.complexity) for s in r.symbols] == [
        ("Foo", "class", 3, 4, 0.0), ("go", "function", 5, 8, 3.0), ("f", "function", 9, 10, 0.0)
    ]
    assert r.symbols[1].signature == "function go(x,\n  y)"


NOTEBOOK = {
    "nbformat": 4, "metadata": {"language_info": {"name": "python"}}, "cells": [
        {"cell_type": "markdown", "source": ["# Sales forecast\n", "This explains forecasting."], "attachments": {"a": "ATTACHED"}},
        {"cell_type": "code", "source": ["def unsafe(value):\n", "    return eval(value)\n"], "outputs": [{"text": "OUTPUT"}]},
        {"cell_type": "code", "source": "%matplotlib inline\nprint(1)", "outputs": []},
    ],
}


def test_scan_of_documents(spark):
    files = spark.createDataFrame(
        [("r", "1", "forecast.ipynb", "notebook", json.dumps(NOTEBOOK)),
         ("r", "2", "settings.json", "json", '{"service":{"name":"forecast","retries":3},"enabled":true}'),
         ("r", "3", "broken.json", "json", "{broken"), ("q", "4", "config.json", "json", '{"enabled":true}'),
         ("p", "5", "bad.py", "python", "def ("), ("p", "6", "ok.py", "python", "x = 1\n"), ("p", "7", "a.rs", "rust", "fn")],
        "repository_id string, file_id string, path string, language string, text string",
    )
    scan = plan.scan_files(files)
    evals = [f for f in scan["findings"].collect() if f.issue_type == "UNSAFE_EVAL"]
    assert [(f.line, f.message.startswith("Cell 2:")) for f in evals] == [(7, True)]
    coverage = {r.repository_id: r for r in scan["coverage"].collect()}
    r = coverage["r"]
    assert (r.notebook_cells_scanned, r.notebook_cells_skipped, r.json_files_validated, r.scanned_loc) == (1, 1, 1, 2)
    assert (coverage["p"].scanned_files, coverage["p"].unsupported_files) == (1, 2)
    reasons = {(e.path, e.reason) for e in scan["exclusions"].collect()}
    assert ("bad.py", V.UNPARSED_PYTHON) in reasons and ("settings.json", V.VALID_JSON) in reasons
    scores = {s.repository_id: s.health_score for s in plan.summarize_scan(scan).collect()}
    assert scores["q"] is None and scores["p"] == 100 and scores["r"] <= 49
    assert "OUTPUT" not in json.dumps([x.asDict() for x in scan["findings"].collect()])


def read(spark, content, language="json", **options):
    rows = spark.createDataFrame([("f", content if isinstance(content, str) else json.dumps(content), language)], "path string, text string, language string")
    return D.read_documents(rows, ["path"], **options)


@pytest.mark.parametrize("text", ["{", '{"b": [], "b": []}', '[1, -Infinity]', "", "tru", "{} {}", '{"x": 1,}'])
def test_invalid_json(spark, text):
    for language in ("json", "notebook"):
        got = read(spark, text, language).first()
        assert (got.valid, got.warnings, got.view, got.sections, got.cells) == (False, [V.UNSOUND_JSON], "", [], [])


def test_limits_are_a_choice(spark):
    deep, keyed = "{\"a\":" * 70 + "1" + "}" * 70, {"k" * 600: [1, "[[[,,\"]"]}
    wide, many = list(range(21_000)), {"nbformat": 4, "cells": [{"cell_type": "raw", "source": "x" * 1100}] * 1001}
    for content, language, reason in ((deep, "json", V.DEEP_JSON), (keyed, "json", V.LONG_KEY), (wide, "json", V.DEEP_JSON), (many, "notebook", V.MANY_CELLS)):
        assert read(spark, content, language).first().valid
        assert read(spark, content, language, limits=V.DOCUMENT_LIMITS).first().warnings == [reason]


@pytest.mark.parametrize("value", [{}, [], 7, "x", [1, {}, [[], {"a": [2]}]], {"a/b~": {"c": [1, [2, 3], {}]}, "é": "[\n{", "z": None}])
def test_json_lines(spark, value):
    """Sections are the lines of each member in the printed text."""
    got = read(spark, json.dumps(value)).first()
    assert got.view == json.dumps(value, indent=2)
    members = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    want, at = [], 2
    for key, member in members:
        height = len(json.dumps(member, indent=2).split("\n"))
        want.append(("/" + str(key).replace("~", "~0").replace("/", "~1"), at, at + height - 1))
        at += height
    assert [(s.name, s.start_line, s.end_line) for s in got.sections] == (want or [("/", 1, 1)])


def test_section_chunks(spark):
    docs = read(spark, {"text": "word " * 1500, "rows": [[1, 2], 3]}).withColumn("lines", X.split_lines(F.col("view")))
    made = C.explode_chunks(docs, C.section_blocks(F.col("lines"), F.col("sections")), ["path"]).collect()
    assert max(len(c.content) for c in made) <= 1601 and sum(c.content.count("word") for c in made) == 1500
    assert all(1 <= c.start_line <= c.end_line <= 9 for c in made)


def test_odd_notebooks(spark):
    book = lambda **more: {"nbformat": 4, "cells": [], **more}
    for content, reason in (
        (book(cells=[{"cell_type": "code", "source": [2]}]), V.BAD_CELL_STRUCTURE.format(1)), (book(cells=[{"cell_type": "raw"}, 5]), V.BAD_CELL.format(2)),
        (book(nbformat="4"), V.NOT_A_NOTEBOOK), (book(nbformat=3), V.NOT_A_NOTEBOOK), (book(cells={}), V.NOT_A_NOTEBOOK), ([], V.NOT_A_NOTEBOOK),
        (book(metadata=[]), V.BAD_METADATA), (book(metadata={"kernelspec": "x"}), V.BAD_KERNEL), (book(metadata={"language_info": {"name": 3}}), V.BAD_KERNEL_NAME),
    ):
        assert read(spark, content, "notebook").first().warnings == [reason]
    cells = [{"cell_type": "code", "source": ["a = 1\n", "b"]}, {"cell_type": "markdown", "source": ""}, {"cell_type": "code", "source": "%magic"}, {"cell_type": "raw"}]
    got = read(spark, book(cells=cells, metadata={"kernelspec": {"language": "Python"}}), "notebook").first()
    assert got.view == "# Cell 1 [code]\na = 1\nb\n\n# Cell 2 [markdown]\n\n\n# Cell 3 [code]\n%magic\n\n# Cell 4 [raw]\n\n"
    assert [(c.number, c.start_line, c.end_line, c.supported) for c in got.cells] == [(1, 2, 3, True), (2, 6, 6, False), (3, 9, 9, False), (4, 12, 12, False)]
    assert [(s.name, s.language) for s in got.sections] == [("Cell 1 (code)", "python"), ("Cell 3 (code)", "python")]
    assert got.warnings == [f"Cell 3: {V.UNSCANNED_CELL}"]
    other = read(spark, {**NOTEBOOK, "metadata": {"language_info": {"name": "julia"}}}, "notebook").first()
    assert other.valid and other.sections and not any(c.supported for c in other.cells)


def loop_sections(lines, section):
    out, buffer, start, end = [], "", section[0], section[0]
    for n in range(section[0], section[1] + 1):
        line = lines[n - 1]
        for o in range(0, max(1, len(line)), 14):
            piece = line[o:o + 14]
            if buffer and len(buffer) + len(piece) > 16:
                out.append((buffer, start, end))
                buffer = ""
            start = start if buffer else n
            buffer, end = buffer + piece + "\n", n
    return out + ([(buffer.rstrip(), start, end)] if buffer.strip() else [])


def test_section_packing_against_loop(spark):
    rng = random.Random(3)
    cases = []
    for i in range(80):
        lines = ["".join(rng.choice("ab ") for _ in range(rng.choice([0, 2, 5, 14, 15, 40]))) for _ in range(rng.randint(1, 12))]
        a = rng.randint(1, len(lines))
        cases.append((i, lines, a, rng.randint(a, len(lines))))
    rows = spark.createDataFrame(cases, "i int, lines array<string>, a int, z int")
    section = F.array(F.struct(F.lit("s").alias("name"), F.lit("t").alias("type"), F.col("a").alias("start_line"),
                               F.col("z").alias("end_line"), F.lit("x").alias("language")))
    out = rows.select("*", C.section_blocks(F.col("lines"), section, fragment=14, limit=16).alias("c")).collect()
    for r in out:
        assert [(c.content, c.start_line, c.end_line) for c in r.c] == loop_sections(r.lines, (r.a, r.z)), r.lines


def loop_chunks(lines, symbols, size):
    """Symbol pieces in start order, then runs of at least three uncovered lines."""
    out, covered = [], set()
    for name, a, z in sorted(symbols, key=lambda s: s[1]):
        own = lines[a - 1:z]
        if not own:
            continue
        covered |= set(range(a - 1, z))
        if len(own) > size:
            for i in range(0, len(own), size):
                part = own[i:i + size]
                if "\n".join(part).strip():
                    out.append((name, "\n".join(part), a + i, a + i + len(part) - 1))
        elif len("\n".join(own).strip()) >= 3:
            out.append((name, "\n".join(own), a, z))
    run = []
    for i in [*(i for i in range(len(lines)) if i not in covered), None]:
        if run and (i is None or i != run[-1] + 1):
            text = "\n".join(lines[j] for j in run)
            if len(run) >= 3 and len(text.strip()) >= 3:
                out.append((None, text, run[0] + 1, run[-1] + 1))
            run = []
        run.append(i)
    return out


def test_symbol_and_gap_chunks_against_loop(spark):
    rng = random.Random(4)
    cases = []
    for i in range(120):
        lines = [rng.choice(["", " ", "ab", "abc d"]) for _ in range(rng.randint(0, 25))]
        symbols, top = [], max(len(lines), 1)
        for k, a in enumerate(sorted(rng.sample(range(1, top + 3), min(3, top)))):
            symbols.append((f"s{k}", a, rng.randint(a, top + 2)))
        cases.append((i, lines, symbols or [("s", 1, 1)]))
    rows = spark.createDataFrame(
        [(i, lines, [(n, "function", a, z, None) for n, a, z in s]) for i, lines, s in cases],
        "i int, lines array<string>, symbols array<struct<name:string,type:string,start_line:int,end_line:int,parent_name:string>>",
    )
    out = rows.select("*", C.file_chunks(F.col("lines"), F.col("symbols"), size=4).alias("c")).collect()
    for r in out:
        got = [(c.symbol_name, c.content, c.start_line, c.end_line) for c in r.c]
        assert got == loop_chunks(r.lines, [(s.name, s.start_line, s.end_line) for s in r.symbols], 4), (r.lines, r.symbols)


def test_long_symbol_pieces(spark):
    lines = ["def long():"] + [f"    x{i} = {i}" for i in range(161)]
    rows = spark.createDataFrame([(lines,)], "lines array<string>")
    symbol = F.array(F.struct(F.lit("long").alias("name"), F.lit("function").alias("type"), F.lit(1).alias("start_line"),
                              F.lit(162).alias("end_line"), F.lit(None).cast("string").alias("parent_name")))
    made = rows.select(C.symbol_blocks(F.col("lines"), symbol).alias("c")).first().c
    assert [(c.start_line, c.end_line) for c in made] == [(1, 150), (151, 162)]


def score(spark, loc, **counts):
    names = ["critical", "high", "medium", "low", "security_critical", "security_high"]
    values = [counts.get(n, 0) for n in names]
    rows = spark.createDataFrame([tuple([loc] + values)], "loc long, " + ", ".join(f"{n} long" for n in names))
    return rows.select(R.health_score(F.col("loc"), *[F.col(n) for n in names])).first()[0]


def test_score_properties(spark):
    assert score(spark, 1000, low=20) == score(spark, 2000, low=40)
    assert score(spark, 1000, high=20) < score(spark, 1000, low=20)
    assert score(spark, 10**6, critical=1, security_critical=1) <= 49
    assert score(spark, 10**6, high=1, security_high=1) <= 79
    assert score(spark, 10) == 100


def test_scores_separate_suggestions(spark):
    def summary(*extra):
        kinds = ["LONG_LINE", "WEAK_JWT_ALG", "DEBUG_PRINT", "LONG_FUNCTION", "TECHNICAL_DEBT_TODO"]
        rows = [("r", k, "HIGH") for k in kinds] + [("r", *e) for e in extra]
        issues = spark.createDataFrame(rows, "repository_id string, issue_type string, severity string")
        coverage = spark.createDataFrame([("r", 1, 100000)], "repository_id string, scanned_files long, scanned_loc long")
        return R.with_health_score(R.severity_summary(issues), coverage).first()

    s = summary()
    assert (s.health_score, s.scored, s.suggestions) == (100, 0, 3)
    assert summary(("HIGH_COMPLEXITY", "HIGH")).health_score > 79
    s = summary(("HIGH_COMPLEXITY", "HIGH"), ("UNSAFE_EVAL", "CRITICAL"))
    assert s.health_score <= 49 and s.findings == 5


def test_children_are_listed_once():
    """Children are those of ast, but for contexts and operators; heads are what ast prints of bare parameters."""
    source = SAFE + "async def f(a, /, b, *c, d=1, **e):\n    return [x for x in b if not x or -x < d]\n\nclass K(dict):\n    def g(): pass\n    h = lambda *i: i\n"
    for node in ast.walk(ast.parse(source)):
        below = [x for x in ast.iter_child_nodes(node) if not isinstance(x, pyfacts.MARKS)]
        assert pyfacts._children(node) == below
        assert not any(list(ast.iter_child_nodes(x)) for x in ast.iter_child_nodes(node) if isinstance(x, pyfacts.MARKS))
    heads = {c["name"]: c["signature"] for c in pyfacts.source_facts(source)["callables"]}
    assert heads["f"] == "async def f(b, *c, **e)" and heads["g"] == "def g()" and heads["K"] == "class K"
