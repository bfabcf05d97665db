"""Registered queries: decoding, chunking, documents, findings.  `documents` plays the file corpus."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..functions.rows import each
from ..operators import chunks as C
from ..operators import code_scan as S
from ..operators import documents as D
from ..operators import js_outline as J
from ..operators import pyfacts
from ..sources import tree
from .registry import SQL_LINES, query, sql_in


def with_lines(t):
    return t.spread("documents").select("doc_id", "source", X.split_lines(F.col("text")).alias("lines"))


@query(
    "decoded_files",
    f"""SELECT doc_id, sha256(text) AS hash, len({SQL_LINES})::INT AS loc, length(text)::BIGINT AS chars
    FROM documents""",
)
def decoded_files(t):
    raw = t("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return tree.decode_files(raw).select("doc_id", "hash", "loc", F.length("text").cast("long").alias("chars"))


@query(
    "line_chunks",
    f"""WITH l AS (SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents),
    b AS (SELECT s.size, doc_id, (i - 1) // s.size AS blk, min(i) AS a, max(i) AS z,
                 string_agg(line, chr(10) ORDER BY i) AS content
          FROM l, (SELECT unnest([150, 10]) AS size) s GROUP BY ALL)
    SELECT size::INT AS block_lines, doc_id,
           (row_number() OVER (PARTITION BY size, doc_id ORDER BY blk) - 1)::INT AS chunk_index,
           a::INT AS start_line, z::INT AS end_line, content
    FROM b WHERE regexp_matches(content, '\\S')""",
)
def line_chunks(t):
    files = with_lines(t)
    parts = [
        C.explode_chunks(files, C.line_blocks(F.col("lines"), n), ["doc_id"]).withColumn("block_lines", F.lit(n))
        for n in (V.BLOCK_LINES, 10)
    ]
    return parts[0].unionByName(parts[1]).select(
        "block_lines", "doc_id", "chunk_index", "start_line", "end_line", "content"
    )


def pseudo_symbols(*ranges):
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(a).alias("start_line"),
                F.lit(b).alias("end_line"), F.lit(None).cast("string").alias("parent_name"),
            )
            for name, kind, a, b in ranges
        ]
    )


@query(
    "symbol_chunks",
    f"""WITH l AS (SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents),
    s AS (SELECT * FROM (VALUES (1, 'head', 'function', 2, 4), (2, 'body', 'class', 2, 12)) v(o, name, kind, a, z)),
    own AS (SELECT doc_id, o, name, kind, a, z, line, i, count(*) OVER (PARTITION BY doc_id, o) AS n
            FROM l JOIN s ON i BETWEEN a AND z),
    c AS (SELECT doc_id, o, name, kind, any_value(z) AS z, n, CASE WHEN n > 4 THEN (i - a) // 4 ELSE 0 END AS blk,
                 min(i) AS first, max(i) AS last, string_agg(line, chr(10) ORDER BY i) AS content
          FROM own GROUP BY doc_id, o, name, kind, n, blk),
    k AS (SELECT * FROM c WHERE CASE WHEN n > 4 THEN regexp_matches(content, '\\S')
                                     ELSE length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) >= 3 END)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o, blk) - 1)::INT AS chunk_index,
           name AS symbol_name, kind AS symbol_type, first::INT AS start_line,
           (CASE WHEN n > 4 THEN last ELSE z END)::INT AS end_line, content FROM k""",
)
def symbol_chunks(t):
    symbols = pseudo_symbols(("head", "function", 2, 4), ("body", "class", 2, 12))
    files = with_lines(t)
    return C.explode_chunks(files, C.symbol_blocks(F.col("lines"), symbols, size=4), ["doc_id"]).select(
        "doc_id", "chunk_index", "symbol_name", "symbol_type", "start_line", "end_line", "content"
    )


@query(
    "gap_chunks",
    f"""WITH l AS (SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents),
    free AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l
             WHERE NOT (i BETWEEN 6 AND 9) AND NOT (i BETWEEN 8 AND 11) AND NOT (i BETWEEN 30 AND 31)),
    g AS (SELECT doc_id, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS content
          FROM free GROUP BY doc_id, island HAVING count(*) >= 3)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS chunk_index,
           a::INT AS start_line, z::INT AS end_line, content
    FROM g WHERE length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) >= 3""",
)
def gap_chunks(t):
    symbols = pseudo_symbols(("a", "function", 6, 9), ("b", "function", 8, 11), ("c", "function", 30, 31))
    files = with_lines(t)
    return C.explode_chunks(files, C.gap_blocks(F.col("lines"), symbols), ["doc_id"]).select(
        "doc_id", "chunk_index", "start_line", "end_line", "content"
    )


@query(
    "section_pack",
    f"""WITH RECURSIVE l AS (
        SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents),
    p AS (SELECT doc_id, i, unnest(range(0, greatest(length(line), 1), 1400)) AS o, line FROM l),
    f AS (SELECT doc_id, i, substr(line, o + 1, 1400) AS t,
                 row_number() OVER (PARTITION BY doc_id ORDER BY i, o) AS k FROM p),
    r AS (SELECT doc_id, k, t || chr(10) AS buffer, i AS a, i AS z, NULL::VARCHAR AS done, NULL::BIGINT AS da,
                 NULL::BIGINT AS dz FROM f WHERE k = 1
          UNION ALL
          SELECT f.doc_id, f.k,
                 CASE WHEN length(r.buffer) + length(f.t) > 1600 THEN '' ELSE r.buffer END || f.t || chr(10),
                 CASE WHEN length(r.buffer) + length(f.t) > 1600 THEN f.i ELSE r.a END, f.i,
                 CASE WHEN length(r.buffer) + length(f.t) > 1600 THEN r.buffer END,
                 r.a, r.z
          FROM r JOIN f ON f.doc_id = r.doc_id AND f.k = r.k + 1),
    c AS (SELECT doc_id, k, done AS content, da AS a, dz AS z FROM r WHERE done IS NOT NULL
          UNION ALL
          SELECT doc_id, k + 1, rtrim(buffer, ' ' || chr(9) || chr(10) || chr(13)), a, z
          FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, a::INT AS start_line,
           z::INT AS end_line, content FROM c WHERE regexp_matches(content, '\\S')""",
)
def section_pack(t):
    section = F.array(
        F.struct(
            F.col("source").alias("name"), F.lit("json_path").alias("type"), F.lit(1).alias("start_line"),
            F.size("lines").alias("end_line"), F.lit("json").alias("language"),
        )
    )
    files = with_lines(t).filter(F.size("lines") > 0)
    return C.explode_chunks(files, C.section_blocks(F.col("lines"), section), ["doc_id"]).select(
        "doc_id", "chunk_index", "start_line", "end_line", "content"
    )


@query(
    "json_keys",
    """SELECT event_id, (i - 1 + 1)::INT AS position, '/' || replace(replace(k, '~', '~0'), '/', '~1') AS pointer,
       json_extract_string(props, '$."' || k || '"') AS value
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS k, generate_subscripts(json_keys(props), 1) AS i
          FROM events WHERE json_valid(props))""",
)
def json_keys(t):
    return D.json_keys(t("events"), "props", ["event_id"]).select("event_id", "position", "pointer", "value")


@query(
    "stored_json",
    """SELECT event_id, CASE WHEN json_valid(s) THEN json(s)::VARCHAR END AS json,
       CASE WHEN NOT json_valid(s) THEN s END AS raw
    FROM (SELECT event_id, CASE event_type WHEN 'error' THEN props || '}' WHEN 'view' THEN event_type ELSE props END AS s
          FROM events)""",
)
def stored_json(t):
    from ..sources.store import parse_jsonish

    stored = F.when(F.col("event_type") == "error", F.concat("props", F.lit("}"))).when(
        F.col("event_type") == "view", F.col("event_type")
    ).otherwise(F.col("props"))
    return t("events").select("event_id", parse_jsonish(stored).alias("p")).select("event_id", "p.json", "p.raw")


@query(
    "json_sections",
    f"""WITH d AS (SELECT doc_id, len({SQL_LINES}) AS n FROM documents)
    SELECT doc_id, s.name, s.a::INT AS start_line, s.z::INT AS end_line FROM (
        SELECT doc_id, unnest([
            {{'name': '/doc_id', 'a': 2, 'z': 2}}, {{'name': '/origin~1lang', 'a': 3, 'z': 6}},
            {{'name': '/lines', 'a': 7, 'z': CASE WHEN n = 0 THEN 7 ELSE 8 + n END}}]) AS s FROM d)""",
)
def json_sections(t):
    body = F.to_json(
        F.struct(
            "doc_id", F.struct("lang", "source").alias("origin/lang"),
            X.split_lines(F.col("text")).alias("lines"),
        )
    )
    files = t.spread("documents").select("doc_id", body.alias("text"), F.lit("json").alias("language"))
    return each(D.read_documents(files, ["doc_id"]), "sections", "s", ["doc_id"]).select(
        "doc_id", "s.name", "s.start_line", "s.end_line"
    )


def notebooks(t):
    """One notebook per document: markdown cells with the lines, code cells that evaluate their length."""
    cells = F.transform(
        X.split_lines(F.col("text")),
        lambda line, i: F.when(
            i % 2 == 0,
            F.struct(F.lit("markdown").alias("cell_type"), line.alias("source")),
        ).otherwise(
            F.struct(
                F.lit("code").alias("cell_type"),
                F.concat(F.lit("n = eval('"), F.length(line).cast("string"), F.lit("')")).alias("source"),
            )
        ),
    )
    book = F.struct(
        F.lit(4).alias("nbformat"),
        F.struct(F.struct(F.lit("python").alias("name")).alias("language_info")).alias("metadata"),
        cells.alias("cells"),
    )
    return t.spread("documents").select("doc_id", F.to_json(book).alias("text"), F.lit("notebook").alias("language"))


@query(
    "notebook_findings",
    f"""SELECT doc_id, 'UNSAFE_EVAL' AS issue_type, 'CRITICAL' AS severity,
       'Cell ' || i || ': Use of eval() can execute code' AS message, ((i - 1) * 3 + 2)::INT AS line
    FROM (SELECT doc_id, generate_subscripts({SQL_LINES}, 1) AS i, len({SQL_LINES}) AS n FROM documents)
    WHERE i % 2 = 0""",
)
def notebook_findings(t):
    cells = D.code_cells(D.read_documents(notebooks(t), ["doc_id"]), ["doc_id"]).filter("supported")
    scanned = S.with_python_findings(cells, ["doc_id", "offset", "label"])
    return S.explode_findings(scanned, ["doc_id", "offset", "label"], "offset", "label").select(
        "doc_id", "issue_type", "severity", "message", "line"
    )


CHECKED = {
    # number of a document modulo 7 -> language, text of the file (D: the document as JSON text), warning
    0: ("json", '{"text":D}', None), 1: ("json", '{"text":D', V.UNSOUND_JSON), 2: ("notebook", '{"nbformat":3,"cells":[{"cell_type":"raw","source":D}]}', V.NOT_A_NOTEBOOK),
    3: ("notebook", '{"nbformat":4,"metadata":{"language_info":{"name":"python"}},"cells":[{"cell_type":"raw","source":D},D]}', V.BAD_CELL.replace("{}", "2")),
    4: ("notebook", '{"nbformat":4,"metadata":{"kernelspec":{"language":"r"}},"cells":[{"cell_type":"unknown","source":D}]}', V.BAD_CELL_STRUCTURE.replace("{}", "1")),
    5: ("notebook", '{"nbformat":4,"metadata":{"language_info":[]},"cells":[{"cell_type":"raw","source":D}]}', V.BAD_KERNEL),
    6: ("notebook", '{"nbformat":4,"metadata":{"language_info":{"name":"Python"}},"cells":[{"cell_type":"markdown","source":[D]},{"cell_type":"code","source":"%%time"}]}',
        f"Cell 2: {V.UNSCANNED_CELL}"),
}


@query(
    "documents_checked",
    f"""SELECT doc_id, doc_id % 7 IN (0, 6) AS valid, CASE doc_id % 7 {" ".join(f"WHEN {i} THEN '{w}'" for i, (_, _, w) in CHECKED.items() if w)} ELSE '' END AS warnings,
      CASE doc_id % 7 WHEN 6 THEN 2 ELSE 0 END AS cells, CASE WHEN doc_id % 7 = 6 THEN greatest(len({SQL_LINES}), 1) + 4 END::INT AS last_start
    FROM documents""",
)
def documents_checked(t):
    """Sound and broken JSON files and notebooks made of the documents, with what their reader says."""
    kind = F.col("doc_id") % len(CHECKED)
    quoted = F.to_json(F.array("text"))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    pick = lambda place, of: F.coalesce(*[F.when(kind == i, of(F.lit(row[place]))) for i, row in CHECKED.items()])
    files = t("documents").select("doc_id", pick(0, lambda c: c).alias("language"), pick(1, lambda c: F.replace(c, F.lit("D"), quoted)).alias("text"))
    return D.read_documents(files, ["doc_id"]).select(
        "doc_id", "valid", F.array_join("warnings", "; ").alias("warnings"), F.size("cells").alias("cells"), F.get("cells", F.lit(1))["start_line"].alias("last_start")
    )


def python_sources(t):
    """One Python file per document: a function per line, with as many parameters as words (modulo 12)."""

    def function(line, i):
        n = F.size(F.split(line, " ")) % 12
        args = F.array_join(
            F.transform(F.sequence(F.lit(0), n), lambda a: F.concat(F.lit("a"), a.cast("string"))), ", "
        )
        return F.concat(
            F.lit("def f"), (i + 1).cast("string"), F.lit("("), args, F.lit("):\n    return eval(str("),
            F.length(line).cast("string"), F.lit("))\n"),
        )

    body = F.array_join(F.transform(X.split_lines(F.col("text")), function), "")
    return t.spread("documents").select(
        "doc_id", "source", F.concat(F.lit("import os\n"), body).alias("text")
    )


SQL_FUNCTIONS = f"""SELECT doc_id, i, len(string_split(line, ' ')) % 12 + 1 AS n FROM (
    SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents)"""


@query(
    "python_symbols",
    f"""SELECT doc_id, 'f' || i AS name, 'function' AS type, (2 * i)::INT AS start_line, (2 * i + 1)::INT AS end_line,
       'def f' || i || '(' || array_to_string(list_transform(range(0, n), lambda a: 'a' || a), ', ') || ')' AS signature,
       1.0::DOUBLE AS complexity FROM ({SQL_FUNCTIONS})""",
)
def python_symbols(t):
    from .index import python_outline

    return each(python_outline(python_sources(t), ["doc_id"]), "symbols", "s", ["doc_id"]).select(
        "doc_id", "s.name", "s.type", "s.start_line", "s.end_line", "s.signature", "s.complexity"
    )


@query(
    "python_findings",
    f"""WITH f AS ({SQL_FUNCTIONS})
    SELECT doc_id, 'UNUSED_IMPORT' AS issue_type, 'LOW' AS severity, 1::INT AS line,
           'Import ''os'' appears to be unused' AS message FROM documents
    UNION ALL SELECT doc_id, 'UNSAFE_EVAL', 'CRITICAL', (2 * i + 1)::INT, 'Use of eval() can execute code' FROM f
    UNION ALL SELECT doc_id, 'TOO_MANY_PARAMS', CASE WHEN n > 8 THEN 'HIGH' ELSE 'MEDIUM' END, (2 * i)::INT,
           'Function ''f' || i || ''' has ' || n || ' parameters' FROM f WHERE n > 5""",
)
def python_findings(t):
    scanned = S.with_python_findings(python_sources(t), ["doc_id"])
    return S.explode_findings(scanned, ["doc_id"]).select("doc_id", "issue_type", "severity", "line", "message")


@query(
    "python_imports",
    """SELECT doc_id, 'os' AS module, 1::INT AS line FROM documents""",
)
def python_imports(t):
    facts = pyfacts.with_python_facts(python_sources(t), ["doc_id"])
    return each(facts, "imports", "i", ["doc_id"]).select("doc_id", "i.module", "i.line")


def script_sources(t):
    """One script per document: a three-line exported function and an import per line."""

    def piece(line, i):
        n = (i + 1).cast("string")
        return F.concat(
            F.lit("const m"), n, F.lit(" = require('./mod"), n, F.lit("')\nexport function g"), n,
            F.lit("(a, b) {\n  if (a&&b) { return "), F.length(line).cast("string"), F.lit(" }\n}\n"),
        )

    body = F.array_join(F.transform(X.split_lines(F.col("text")), piece), "")
    return t.spread("documents").select(
        "doc_id",
        F.concat(body, F.lit("export default class Box {\n  run() {\n  }\n}\nconst go = async (x) => {\n  x\n}\n")).alias("text"),
    )


@query(
    "script_symbols",
    f"""WITH d AS (SELECT doc_id, len({SQL_LINES}) AS n FROM documents),
    f AS (SELECT doc_id, unnest(range(1, n + 1)) AS i FROM d)
    SELECT doc_id, 'g' || i AS name, 'function' AS type, (4 * i - 2)::INT AS start_line, (4 * i)::INT AS end_line,
           'function g' || i || '(a, b)' AS signature, 3.0::DOUBLE AS complexity FROM f
    UNION ALL SELECT doc_id, 'Box', 'class', (4 * n + 1)::INT, (4 * n + 4)::INT, 'class Box', 0.0 FROM d
    UNION ALL SELECT doc_id, 'go', 'function', (4 * n + 5)::INT, (4 * n + 7)::INT, 'const go = () =>', 0.0 FROM d""",
)
def script_symbols(t):
    return each(J.with_js_outline(script_sources(t)), "symbols", "s", ["doc_id"]).select(
        "doc_id", "s.name", "s.type", "s.start_line", "s.end_line", "s.signature", "s.complexity"
    )


@query(
    "script_imports",
    f"""SELECT doc_id, './mod' || i AS module, (4 * i - 3)::INT AS line
    FROM (SELECT doc_id, generate_subscripts({SQL_LINES}, 1) AS i FROM documents)""",
)
def script_imports(t):
    lines = script_sources(t).select("doc_id", X.split_lines(F.col("text")).alias("lines"))
    return each(lines, J.js_imports(F.col("lines")), "i", ["doc_id"]).select("doc_id", "i.module", "i.line")


def marked_scripts(t):
    """Script lines made from document lines: declarations, placeholders, comments, hash calls, plain text."""

    def piece(line, i):
        digest = F.md5(line)
        return (
            F.when(i % 7 == 0, F.concat(F.lit('const access_token = "'), digest, F.lit('";')))
            .when(i % 7 == 1, F.lit("  password: string = 'changeme'"))
            .when(i % 7 == 2, F.concat(F.lit("/* "), F.when(F.length(line) % 2 == 0, "closed */").otherwise("open")))
            .when(i % 7 == 3, F.concat(F.lit("db_password = '"), digest, F.lit("' // "), F.lit("why")))
            .when(i % 7 == 4, F.concat(F.lit("end */ # fixme "), F.substring(digest, 1, 4)))
            .when(i % 7 == 5, F.lit("let h = crypto.createHash( 'SHA1' )"))
            .otherwise(line)
        )

    return t.spread("documents").select(
        "doc_id", F.array_join(F.transform(X.split_lines(F.col("text")), piece), "\n").alias("text"),
        F.lit("javascript").alias("language"),
    )


SQL_MARKED = f"""SELECT doc_id, i, CASE (i - 1) % 7
      WHEN 0 THEN 'const access_token = "' || md5(line) || '";'
      WHEN 1 THEN '  password: string = ''changeme'''
      WHEN 2 THEN '/* ' || CASE WHEN length(line) % 2 = 0 THEN 'closed */' ELSE 'open' END
      WHEN 3 THEN 'db_password = ''' || md5(line) || ''' // why'
      WHEN 4 THEN 'end */ # fixme ' || substr(md5(line), 1, 4)
      WHEN 5 THEN 'let h = crypto.createHash( ''SHA1'' )'
      ELSE line END AS line
    FROM (SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents)"""
SQL_ASSIGN = (
    r"""^\s*(?:(?:export\s+)?(?:const|let|var)\s+)?(\w+)\s*(?::\s*string\s*)?=\s*(?:"(.*?)"|''(.*?)'')\s*[;,]?\s*(?://.*)?$"""
)


@query(
    "script_findings",
    f"""WITH m AS ({SQL_MARKED}),
    e AS (SELECT *, CASE WHEN contains(line, '*/') THEN 0 WHEN starts_with(trim(line), '/*') THEN 1 END AS ev FROM m),
    s AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM e),
    code AS (SELECT * FROM s WHERE inside = 0 AND NOT starts_with(trim(line), '/*')
             AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '//')),
    a AS (SELECT doc_id, i, regexp_extract(line, '{SQL_ASSIGN}', 1) AS name,
                 regexp_extract(line, '{SQL_ASSIGN}', 2) || regexp_extract(line, '{SQL_ASSIGN}', 3) AS value
          FROM code WHERE regexp_matches(line, '{SQL_ASSIGN}'))
    SELECT doc_id, i::INT AS line, 'HIGH' AS severity, CASE WHEN contains(lower(name), 'password')
             OR lower(name) IN ('passwd', 'pwd') THEN 'HARDCODED_PASSWORD' ELSE 'HARDCODED_SECRET' END AS issue_type
    FROM a WHERE regexp_full_match(lower(name), '{V.CREDENTIAL_NAME}') AND length(trim(value)) >= 4
      AND lower(trim(value)) NOT IN {sql_in(V.PLACEHOLDER_VALUES)}
      AND NOT starts_with(trim(value), '${{') AND NOT starts_with(trim(value), '{{{{') AND NOT starts_with(trim(value), '<')
    UNION ALL SELECT doc_id, i::INT, 'MEDIUM',
      'WEAK_HASH_' || upper(regexp_extract(line, '(?i)\\b(?:crypto\\.)?createHash\\(\\s*[''"](md5|sha1)[''"]\\s*\\)', 1))
    FROM code WHERE regexp_matches(line, '(?i)\\b(?:crypto\\.)?createHash\\(\\s*[''"](md5|sha1)[''"]\\s*\\)')
    UNION ALL SELECT doc_id, i::INT, 'LOW',
      'TECHNICAL_DEBT_' || upper(regexp_extract(line, '(?i)#\\s*(TODO|FIXME|HACK|XXX|BUG|WORKAROUND)', 1))
    FROM m WHERE regexp_matches(line, '(?i)#\\s*(TODO|FIXME|HACK|XXX|BUG|WORKAROUND)')""",
)
def script_findings(t):
    return S.explode_findings(S.with_script_findings(marked_scripts(t)), ["doc_id"]).select(
        "doc_id", "line", "severity", "issue_type"
    )


@query(
    "debt_print_findings",
    f"""WITH m AS (SELECT doc_id, i, CASE (i - 1) % 5 WHEN 0 THEN '# ' || (['todo', 'XXX', 'Hack'])[(i % 3)::INT + 1] || ' ' || line
        WHEN 1 THEN '  print (' || line || ')' ELSE line END AS line
      FROM (SELECT doc_id, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents))
    SELECT doc_id, i::INT AS line, 'TECHNICAL_DEBT_' || tag AS issue_type,
      tag || ' comment found: ' || substr(trim(line), 1, 60) AS message
    FROM (SELECT *, upper(regexp_extract(line, '(?i)#\\s*(TODO|FIXME|HACK|XXX|BUG|WORKAROUND)', 1)) AS tag FROM m)
    WHERE tag <> ''
    UNION ALL SELECT doc_id, i::INT, 'DEBUG_PRINT', 'print() statement found at line ' || i
    FROM m WHERE regexp_matches(line, '^\\s*print\\s*\\(')""",
)
def debt_print_findings(t):
    tags = F.array(F.lit("todo"), F.lit("XXX"), F.lit("Hack"))
    lines = F.transform(
        X.split_lines(F.col("text")),
        lambda line, i: F.when(
            i % 5 == 0, F.concat(F.lit("# "), F.get(tags, (i + 1) % 3), F.lit(" "), line)
        ).when(i % 5 == 1, F.concat(F.lit("  print ("), line, F.lit(")"))).otherwise(line),
    )
    files = t.spread("documents").select("doc_id", lines.alias("lines")).select(
        "doc_id", S.generic_smell_findings(F.col("lines"), F.lit("python")).alias("findings")
    )
    return S.explode_findings(files, ["doc_id"]).select("doc_id", "line", "issue_type", "message")
