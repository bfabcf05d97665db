"""Registered queries that reach every rule, plugged-in parsers and analyzers, and values that other queries only count."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed_values as V
from ..functions import paths as P
from ..functions import text as X
from ..functions.rows import each
from ..operators import accounts as A
from ..operators import inventory as N
from ..operators import js_outline as J
from ..operators import prompts, views
from ..operators import retrieval as R
from ..sources import tree
from . import index, plugins, scan
from .catalog_accounts import SQL_ADMISSIONS, SQL_FILES, SQL_REPOSITORIES, admissions, block_chunks, import_repositories, line_symbols
from .catalog_search import ranked_documents
from .catalog_tables import corpus_files
from .registry import SQL, SQL_LINES, query, sql_in, sql_list

HIGH, LOW, MEDIUM, CRITICAL = "HIGH", "LOW", "MEDIUM", "CRITICAL"


def _deep(levels):
    return "".join(f"{'    ' * (i + 1)}if x:\n" for i in range(levels)) + "    " * (levels + 1) + "x = 1\n"


# a document ends with the source at its number modulo their count; the findings name lines of that source
SOURCES = [
    (
        "import pickle\nimport hashlib\nimport subprocess\nimport os\npickle.loads(v0)\nhashlib.md5(b'x')\nsubprocess.run(v0 + '', shell=True)\nos.system(v0 + 'x')\n"
        "cursor.execute('SELECT 1' + v0)\nexec(v0)\npassword = 'hunter22'\napi_key = 'abcdef99'\nhashlib.new('SHA1')\nhashlib.md5(b'x', usedforsecurity=False)\n",
        [
            ("UNSAFE_DESERIALIZATION", HIGH, 5), ("WEAK_HASH_MD5", MEDIUM, 6), ("COMMAND_INJECTION", CRITICAL, 7), ("COMMAND_INJECTION", CRITICAL, 8), ("SQL_INJECTION", CRITICAL, 9),
            ("UNSAFE_EVAL", CRITICAL, 10), ("HARDCODED_PASSWORD", HIGH, 11), ("HARDCODED_SECRET", HIGH, 12), ("WEAK_HASH_SHA1", MEDIUM, 13),
        ],
    ),
    ("from Crypto.Cipher import DES\nDES.new(v0)\npassword = 'changeme'\ntoken = '${X}'\n", [("WEAK_CIPHER_DES", HIGH, 2)]),
    (
        "def long(a, b, c, d, e, f, g, h, i):\n" + "    x = 1\n" * 101 + "def shorter(a, b, c, d, e, f):\n" + "    x = 1\n" * 51,
        [("LONG_FUNCTION", HIGH, 1), ("TOO_MANY_PARAMS", HIGH, 1), ("LONG_FUNCTION", MEDIUM, 103), ("TOO_MANY_PARAMS", MEDIUM, 103)],
    ),
    ("def branchy(x):\n" + "    if x:\n        x = 1\n" * 11 + "def worse(x):\n" + "    if x:\n        x = 1\n" * 17, [("HIGH_COMPLEXITY", MEDIUM, 1), ("HIGH_COMPLEXITY", HIGH, 24)]),
    ("def deep(x):\n" + _deep(5) + "def deeper(x):\n" + _deep(7), [("DEEP_NESTING", MEDIUM, 1), ("DEEP_NESTING", HIGH, 8)]),
    ("class Many:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(16)), [("TOO_MANY_METHODS", MEDIUM, 1)]),
    ("class Large:\n" + "".join(f"    a{i} = {i}\n" for i in range(202)), [("LARGE_CLASS", MEDIUM, 1)]),
    (
        "import os\ndef hollow():\n    pass\n# TODO more\nprint(1)\nclass A:\n    def __init__(self):\n        pass\n",
        [("UNUSED_IMPORT", LOW, 1), ("EMPTY_FUNCTION", LOW, 2), ("TECHNICAL_DEBT_TODO", LOW, 4), ("DEBUG_PRINT", LOW, 5)],
    ),
    ("def (\n", []),
]
BROKEN = len(SOURCES) - 1


def ruled_files(t):
    """A Python file per document: an assignment for each of its lines, then the source of its number."""
    ends = F.element_at(F.array(*[F.lit(s) for s, _ in SOURCES]), (F.col("doc_id") % len(SOURCES) + 1).cast("int"))
    own = F.transform(X.split_lines(F.coalesce("text", F.lit(""))), lambda line, i: F.concat(F.lit("v"), i.cast("string"), F.lit(" = "), F.length(line).cast("string"), F.lit("\n")))
    return t("documents").select(
        F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.lit("python").alias("language"), F.concat(F.array_join(own, ""), ends).alias("text"),
    )


RULED = ", ".join(f"({k}, '{rule}', '{severity}', {line})" for k, (_, found) in enumerate(SOURCES) for rule, severity, line in found)
SQL_COUNTED = f"SELECT source AS repository_id, doc_id, 'doc' || doc_id || '.py' AS path, len({SQL_LINES}) AS n FROM documents"


@query(
    "scan_findings",
    f"""SELECT repository_id, path, rule AS issue_type, severity, (n + line)::INT AS line FROM ({SQL_COUNTED}) JOIN (VALUES {RULED}) AS r(k, rule, severity, line) ON doc_id % {len(SOURCES)} = k
    UNION ALL SELECT repository_id, path, 'EXCLUDED', '{V.UNPARSED_PYTHON}', NULL FROM ({SQL_COUNTED}) WHERE doc_id % {len(SOURCES)} = {BROKEN}""",
)
def scan_findings(t):
    """All findings and exclusions of a scan of files that break every rule for Python."""
    found = scan.scan_files(ruled_files(t))
    excluded = found["exclusions"].select("repository_id", "path", F.lit("EXCLUDED").alias("issue_type"), F.col("reason").alias("severity"), F.lit(None).cast("int").alias("line"))
    return found["findings"].select("repository_id", "path", "issue_type", "severity", "line").unionByName(excluded)


@query(
    "plugged_analyzer",
    f"""SELECT source AS repository_id, doc_id::VARCHAR AS file_id, 'LONG_LINE' AS issue_type, i::INT AS line, length(line) || ' characters' AS message FROM (
      SELECT source, doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents) WHERE length(line) > 200""",
)
def plugged_analyzer(t):
    """A rule of the caller's own, over files of a language that no built-in rule reads."""

    def long_lines(files):
        lines = each(files, X.split_lines(F.col("text")), "l", scan.KEYS, position="p")
        return lines.filter(F.length("l") > 200).select(
            *scan.KEYS, F.lit("LONG_LINE").alias("issue_type"), F.lit(LOW).alias("severity"), F.concat(F.length("l").cast("string"), F.lit(" characters")).alias("message"),
            (F.col("p") + 1).cast("int").alias("line"), F.lit("Break the line").alias("suggestion"),
        )

    files = t("documents").select(
        F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("file_id"), F.lit("a.txt").alias("path"), F.lit("text").alias("language"), "text",
    )
    return scan.scan_files(files, analyzers=[long_lines])["findings"].select("repository_id", "file_id", "issue_type", "line", "message")


def parse_paragraphs(text):
    """A parser of the caller's own: every tenth line is a section, the lines up to the next one are its body."""
    lines = text.split("\n")
    starts = range(1, len(lines) + 1, 10)
    symbols = [
        dict(name=f"section{a}", type="function", start_line=a, end_line=min(a + 9, len(lines)), parent_name=None, signature=None, docstring=None, complexity=float(len(lines[a - 1]) % 7))
        for a in starts
    ]
    return dict(error=None, parsed_symbols=symbols, parsed_imports=[])


@query(
    "plugged_parser",
    """WITH l AS (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
      FROM documents WHERE octet_length(encode(coalesce(text, ''))) <= 1048576),
    s AS (SELECT source, doc_id, length(line) % 7 AS c FROM l WHERE i % 10 = 1)
    SELECT source AS repository_id, 'doc' || doc_id || '.rb' AS path, 0::BIGINT AS num_classes, count(*) AS num_functions, coalesce(round(avg(c) FILTER (c > 0), 2), 0)::DOUBLE AS complexity_score
    FROM s GROUP BY source, doc_id""",
)
def plugged_parser(t):
    """Files of a language that the library doesn't parse, indexed with a registered parser: counts and mean complexity."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    files = t("documents").select(
        F.col("source").alias("repository_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".rb")).alias("path"), text.alias("content"), F.octet_length(text).cast("long").alias("size")
    )
    tables = index.index_tree(files, dependents="none", dimensions=8, parsers={"ruby": parse_paragraphs})
    return tables["files"].select("repository_id", "path", "num_classes", "num_functions", "complexity_score")


def strict_paragraphs(text):
    """The parser above, which fails for texts of one line."""
    if "\n" not in text:
        raise ValueError("one line")
    return parse_paragraphs(text)


@query(
    "sql_parser",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT doc_id AS file_id, 'section' || i AS name, i::INT AS start_line, least(i + 9, n)::INT AS end_line, (length(line) % 7)::DOUBLE AS complexity, NULL AS error FROM l WHERE n > 1 AND i % 10 = 1
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'ValueError: one line' FROM l WHERE n = 1""",
)
def sql_parser(t):
    """A parser called from SQL; a text that it fails for is a row with the error."""
    plugins.register_parser(t.spark, "parse_paragraphs", strict_paragraphs)
    t("documents").createOrReplaceTempView("sql_parser_documents")
    return t.spark.sql(
        "SELECT file_id, name, start_line, end_line, complexity, error FROM parse_paragraphs(TABLE(SELECT doc_id AS file_id, text FROM sql_parser_documents))"
    )


def twin_watch():
    """An analyzer that remembers the last file: it reports one that has as many lines as the one before it."""
    last = []

    def look(path, text):
        lines = text.count("\n")
        if last and last[0][1] == lines:
            yield "TWIN", "LOW", f"as many lines as {last[0][0]}", lines + 1
        last[:] = [(path, lines)]

    return look


@query(
    "sql_analyzer",
    """WITH f AS (SELECT source AS repository_id, 'doc' || doc_id AS path, length(text) - length(replace(text, chr(10), '')) AS n FROM documents),
    w AS (SELECT *, lag(n) OVER o AS before, lag(path) OVER o AS previous FROM f WINDOW o AS (PARTITION BY repository_id ORDER BY path))
    SELECT repository_id, path, 'TWIN' AS issue_type, 'as many lines as ' || previous AS message, (n + 1)::INT AS line FROM w WHERE before = n""",
)
def sql_analyzer(t):
    """An analyzer called from SQL, over the files of every repository in the order of their paths."""
    plugins.register_analyzer(t.spark, "twins", twin_watch)
    t("documents").createOrReplaceTempView("sql_analyzer_documents")
    return t.spark.sql(
        """SELECT repository_id, path, issue_type, message, line
        FROM twins(TABLE(SELECT source AS repository_id, 'doc' || doc_id AS path, text FROM sql_analyzer_documents))"""
    )


@query(
    "script_import_forms",
    f"""SELECT doc_id, CASE WHEN i % 5 = 3 THEN './q' ELSE './m' END || i AS module, i::INT AS line
    FROM (SELECT doc_id, generate_subscripts({SQL_LINES}, 1) AS i FROM documents) WHERE i % 5 <> 4""",
)
def script_import_forms(t):
    """Default, named, mixed and required imports, and a call that is none, a line each."""
    forms = ["import a from './m{}'", 'import { x, y } from "./m{}"', "import d, { z } from './m{}'", "let q = require('./q{}')", "load('./m{}')"]
    number = lambda i: (i + 1).cast("string")
    made = lambda i: F.replace(F.element_at(F.array(*map(F.lit, forms)), ((i + 1) % 5 + 1).cast("int")), F.lit("{}"), number(i))
    lines = t("documents").select("doc_id", F.transform(X.split_lines(F.col("text")), lambda _, i: made(i)).alias("lines"))
    return each(lines, J.js_imports(F.col("lines")), "i", ["doc_id"]).select("doc_id", "i.module", "i.line")


@query(
    "unclean_files",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'binary content' END AS reason,
      CASE WHEN doc_id % 3 <> 0 THEN length(coalesce(text, '')) + 2 END::BIGINT AS dropped, CASE WHEN doc_id % 3 <> 0 THEN length(coalesce(text, '')) + 3 END::BIGINT AS shown FROM documents""",
)
def unclean_files(t):
    """Files with a byte that is no UTF-8, some with a zero byte too: left out, or decoded without the byte or with a mark for it."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    content = F.concat(F.lit(b"a\xffb"), F.when(F.col("doc_id") % 3 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")), text)
    files = t("documents").select("doc_id", F.lit("r").alias("repository_id"), F.lit("a.go").alias("path"), content.alias("content"), F.lit(3).cast("long").alias("size"))
    reasons = files.select("doc_id", F.when(P.is_binary(F.col("content")), "binary content").alias("reason"))
    kept = tree.select_files(files)
    length = lambda errors: tree.decode_files(kept, errors).select("doc_id", F.length("text").cast("long").alias("dropped" if errors == "drop" else "shown"))
    return reasons.join(length("drop"), "doc_id", "left").join(length("replace"), "doc_id", "left")


@query(
    "repository_view",
    f"""SELECT repository_id, path, language, coalesce(importance_level, 'none') AS level, importance_score, num_classes::BIGINT AS num_classes, num_functions::BIGINT AS num_functions, loc::BIGINT AS loc,
      CASE WHEN size % 2 = 0 THEN 'summary of ' || path END AS summary, row_number() OVER (PARTITION BY repository_id ORDER BY importance_score DESC, path)::INT AS place FROM ({SQL_FILES})""",
)
def repository_view(t):
    files = corpus_files(t).withColumn("summary", F.when(F.col("size") % 2 == 0, F.concat(F.lit("summary of "), "path")))
    return N.repository_view(files).select(
        "repository_id", "path", "language", F.coalesce("importance_level", F.lit("none")).alias("level"), "importance_score", "num_classes", "num_functions", "loc", "summary", "place"
    )


ISSUE_TYPES = ["UNSAFE_EVAL", "LARGE_CLASS", "UNUSED_IMPORT"]
SQL_ISSUES = f"SELECT repository_id, {sql_list(ISSUE_TYPES)}[size % 3 + 1] AS issue_type FROM ({SQL_FILES})"


def file_issues(t):
    return corpus_files(t).select("repository_id", F.element_at(F.array(*map(F.lit, ISSUE_TYPES)), (F.col("size") % 3 + 1).cast("int")).alias("issue_type"))


@query(
    "dashboard_findings",
    f"""WITH r AS (SELECT repository_id, count(*) AS n, sum(loc) AS loc FROM ({SQL_FILES}) GROUP BY ALL HAVING sum(loc) % 3 <> 0)
    SELECT count(*) AS repositories, sum(n)::BIGINT AS files, sum(loc)::BIGINT AS loc, (SELECT count(*) FROM ({SQL_ISSUES}) WHERE repository_id IN (SELECT repository_id FROM r)) AS issues FROM r""",
)
def dashboard_findings(t):
    repos = N.repository_totals(corpus_files(t)).withColumn("status", F.when(F.col("total_loc") % 3 != 0, "READY").otherwise("FAILED"))
    return N.dashboard_totals(repos, file_issues(t))


@query(
    "scored_stats",
    f"""SELECT f.repository_id, total_files, coalesce(n, 0) AS issues_count FROM (SELECT repository_id, count(*) AS total_files FROM ({SQL_FILES}) GROUP BY ALL) f
    LEFT JOIN (SELECT repository_id, count(*) AS n FROM ({SQL_ISSUES}) WHERE issue_type IN {sql_in(V.SECURITY_RULES + V.STRUCTURE_RULES)} GROUP BY ALL) i USING (repository_id)""",
)
def scored_stats(t):
    return N.repository_stats(corpus_files(t), file_issues(t)).select("repository_id", "total_files", "issues_count")


@query("summaries_cached", f"SELECT id AS file_id FROM ({SQL_FILES}) WHERE importance_level = 'HIGH' AND (size % 4 <> 0 OR size % 8 = 0)")
def summaries_cached(t):
    """Summaries still to be written: of a quarter of the files there is one, but half of those are of an older version."""
    files = corpus_files(t).withColumns({"hash": F.col("path"), "imports": F.array().cast("array<struct<module:string,line:int>>")})
    inputs = prompts.file_summary_input(files, line_symbols(t), block_chunks(t))
    known = inputs.join(files.filter("size % 4 = 0").select(F.col("id").alias("file_id"), "size"), "file_id")
    version = F.when(F.col("size") % 8 == 0, "v0").otherwise("v1")
    cache = known.select(X.fingerprint(version, F.col("hash"), F.col("path"), F.col("symbol_list"), F.col("import_list")).alias("summary_key"))
    return prompts.pending_file_summaries(inputs, files, cache, "v1").select("file_id")


@F.pandas_udf(StringType())
def first_words(texts: pd.Series) -> pd.Series:
    """A generator that SQL can repeat."""
    return texts.map(lambda text: " ".join(text.split(" ")[:3]))


@query("generated_answers", "SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:3], ' ') AS answer FROM conversations WHERE role = 'user'")
def generated_answers(t):
    """Every distinct user turn goes through a plugged-in generator once."""
    asked = t("conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    return prompts.generate(asked, first_words).select("conv_id", "turn", "answer")


@query(
    "restart_recovery",
    f"""SELECT r.id AS repository_id, CASE r.status WHEN 'PARSING' THEN 'FAILED' ELSE r.status END AS status, CASE r.status WHEN 'PARSING' THEN '{V.INTERRUPTED_IMPORT}' END AS error_message,
      CASE a.status WHEN 'RESERVED' THEN 'FAILED' ELSE a.status END AS admission FROM ({SQL_REPOSITORIES}) r JOIN ({SQL_ADMISSIONS}) a ON a.repository_id = r.id""",
)
def restart_recovery(t):
    """What a restart makes of imports that were under way and of their reservations."""
    repositories = A.recover_repositories(import_repositories(t).withColumn("error_message", F.lit(None).cast("string")))
    closed = A.fail_reservations(admissions(t)).select("repository_id", F.col("status").alias("admission"))
    return repositories.select(F.col("id").alias("repository_id"), "status", "error_message").join(closed, "repository_id")


@query(
    "repository_summary_prompt",
    f"""SELECT repository_id, 'repo ' || repository_id AS name, total_files, total_loc, line AS language_line, important_files
    FROM (SELECT repository_id, count(*) AS total_files, sum(loc)::BIGINT AS total_loc FROM ({SQL_FILES}) GROUP BY ALL)
    JOIN ({SQL["language_lines"]}) USING (repository_id) JOIN ({SQL["repository_prompt"]}) USING (repository_id)""",
)
def repository_summary_prompt(t):
    files = corpus_files(t).withColumn("importance_level", F.coalesce("importance_level", F.lit(LOW)))
    totals = N.repository_totals(files).join(N.language_maps(N.language_histogram(files)), "repository_id")
    named = totals.select(F.col("repository_id").alias("id"), F.concat(F.lit("repo "), "repository_id").alias("name"), "total_files", "total_loc", "languages")
    return prompts.repository_summary_input(named, files)


@query(
    "answer_contexts",
    f"""SELECT source, CASE WHEN length(source) % 2 = 0 THEN '## Repository Overview' || chr(10) || 'About ' || source || chr(10) || chr(10) ELSE '' END || context AS context,
      least(n_sources, 6)::INT AS n_shown FROM ({SQL["context_text"]})""",
)
def answer_contexts(t):
    """Contexts with the overview of their repository, where there is one, and the sources listed under the answer."""
    packed = R.pack_context(ranked_documents(t), "source", "position", F.lit(V.RESERVED_TOKENS), width=512)
    summary = F.when(F.length("source") % 2 == 0, F.concat(F.lit("About "), "source"))
    return R.context_text(packed, "source", "position").select(
        "source", R.with_repository_overview(F.col("context"), summary).alias("context"), F.size(views.shown_sources(F.col("sources"))).alias("n_shown")
    )
