"""Registered queries: read views, and the index and scan plans over whole corpora made from `documents`."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..operators import chunks as C
from ..operators import inventory as N
from ..operators import retrieval as R
from ..operators import scores as SC
from ..operators import snapshots as D
from ..operators import views as W
from ..session import work_path
from ..sources import store
from . import index, refresh, scan
from .catalog_accounts import SQL_BLOCKS, SQL_REPOSITORIES, SQL_SYMBOLS, block_chunks, import_repositories, line_symbols
from .catalog_chunks import marked_scripts, notebooks, python_sources
from .catalog_search import SQL_CANDIDATES, SQL_TERMS, page_chunks, page_questions
from .catalog_tables import SQL_FILES, SQL_JOBS, corpus_files, event_jobs
from .registry import SQL_LINES, query, sql_in


@query(
    "question_terms",
    f"""SELECT item_id, array_to_string(list_sort(list_filter(t, lambda w: w NOT IN {sql_in(V.STOP_WORDS)})), ' ') AS terms,
      array_to_string(list_sort(list_filter(t, lambda w: length(w) > 3)), ' ') AS keywords
    FROM (SELECT item_id, {SQL_TERMS} AS t FROM benchmark)""",
)
def question_terms(t):
    joined = lambda c: F.array_join(F.sort_array(c), " ").alias(c)
    return page_questions(t).select(F.col("question_id").alias("item_id"), joined("terms"), joined("keywords"))


@query(
    "hybrid_candidates",
    f"""WITH h AS (SELECT item_id AS question_id, page_id AS id, round(1.0::DOUBLE / (1 + page_id), 4) AS score
        FROM benchmark JOIN pages ON page_id % 50 = item_id % 50)
    SELECT question_id, id, score FROM h UNION ALL
    SELECT question_id, id, 0.3::DOUBLE FROM ({SQL_CANDIDATES}) c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.question_id = c.question_id AND h.id = c.id)""",
)
def hybrid_candidates(t):
    questions, chunks = page_questions(t), page_chunks(t)
    hits = questions.select("question_id", (F.col("question_id") % 50).alias("m")).join(
        t("pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 50).alias("m")), "m"
    ).select(
        F.lit("pages").alias("repository_id"), "question_id", "id", F.round(1.0 / (1 + F.col("id")), 4).alias("score"),
        F.lit(1).alias("rank"),
    )
    return R.hybrid_candidates(hits, R.keyword_candidates(chunks, questions)).select("question_id", "id", "score")


@query(
    "ready_gate",
    f"""SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE o_orderkey IN (SELECT id FROM ({SQL_REPOSITORIES}) WHERE status = 'READY')""",
)
def ready_gate(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return W.ready_only(rows, import_repositories(t), key="o_orderkey")


@query("ready_repositories", f"SELECT id FROM ({SQL_REPOSITORIES}) WHERE status = 'READY'")
def ready_repositories(t):
    return W.ready_repositories(import_repositories(t)).select("id")


@query(
    "recent_repositories",
    """WITH o AS (SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY created_at DESC, id LIMIT 5)
    SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created FROM o""",
)
def recent_repositories(t):
    repos = t("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"),
        F.create_map(F.col("o_orderpriority"), F.lit(1)).alias("languages"),
    )
    return W.recent_repositories(repos).select("id", X.iso_timestamp(F.col("created_at")).alias("created"))


@query(
    "message_order",
    "SELECT conv_id, turn, role, length(text)::BIGINT AS chars FROM conversations ORDER BY turn, role DESC, conv_id",
)
def message_order(t):
    messages = t("conversations").select(
        "conv_id", F.col("turn").alias("created_at"), "role", F.length("text").cast("long").alias("chars"), F.col("conv_id").alias("id")
    )
    return R.in_message_order(messages).select("conv_id", F.col("created_at").alias("turn"), "role", "chars")


@query(
    "files_by_importance",
    f"SELECT repository_id, path, importance_score FROM ({SQL_FILES}) ORDER BY importance_score DESC, path",
)
def files_by_importance(t):
    return W.files_by_importance(corpus_files(t).select("repository_id", "path", "importance_score"))


@query("symbol_order", f"SELECT file_id, name, start_line::INT AS start_line FROM ({SQL_SYMBOLS}) ORDER BY start_line, name")
def symbol_order(t):
    return W.in_symbol_order(line_symbols(t).select("file_id", "name", "start_line"))


@query("testable_symbols", f"SELECT file_id, name, type FROM ({SQL_SYMBOLS}) WHERE type IN ('function', 'method')")
def testable_symbols(t):
    return N.testable_symbols(line_symbols(t)).select("file_id", "name", "type")


@query(
    "testable_files",
    """SELECT doc_id FROM documents WHERE lang IN ('en', 'de')""",
)
def testable_files(t):
    language = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "de", "go").otherwise("rust")
    return N.testable_files(t("documents").select("doc_id", language.alias("language"))).select("doc_id")


@query(
    "summary_status",
    f"""SELECT path, importance_score, id % 3 = 0 AS has_summary FROM ({SQL_FILES})""",
)
def summary_status(t):
    files = corpus_files(t).withColumn("summary", F.when(F.col("id") % 3 == 0, "text").when(F.col("id") % 3 == 1, ""))
    return N.summary_status(files).select("path", "importance_score", F.coalesce("has_summary", F.lit(False)).alias("has_summary"))


@query(
    "searchable_files",
    f"""SELECT f.id, f.id IN (SELECT file_id FROM ({SQL_BLOCKS}) WHERE start_line > 10) AS searchable FROM ({SQL_FILES}) f""",
)
def searchable_files(t):
    return N.with_searchable(corpus_files(t).select("id"), block_chunks(t).filter("start_line > 10"))


@query(
    "parse_status",
    """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'failed' WHEN length(text) % 2 = 0 THEN 'partial' ELSE 'complete' END AS status FROM documents""",
)
def parse_status(t):
    error = F.when(F.col("lang") == "fr", "cannot be read")
    notes = F.when(F.length("text") % 2 == 0, F.array(F.lit("unclosed"))).otherwise(F.array().cast("array<string>"))
    return t("documents").select("doc_id", N.parse_status(error, notes).alias("status"))


@query(
    "chunks_in_symbol",
    f"""SELECT c.file_id, c.chunk_index::INT AS chunk_index FROM ({SQL_BLOCKS}) c WHERE EXISTS (SELECT 1 FROM ({SQL_SYMBOLS}) s
      WHERE s.file_id = c.file_id AND s.name = c.symbol_name AND c.start_line >= s.start_line AND c.end_line <= s.end_line + 9)""",
)
def chunks_in_symbol(t):
    symbols = line_symbols(t).withColumn("end_line", F.col("end_line") + 9)
    return C.chunks_in_symbol(block_chunks(t), symbols).select("file_id", "chunk_index")


@query(
    "stale_indexes",
    f"""SELECT id FROM ({SQL_REPOSITORIES}) WHERE id % 4 <> 1""",
)
def stale_indexes(t):
    version = F.when(F.col("id") % 4 == 1, index.PIPELINE_VERSION).when(F.col("id") % 4 == 2, "older")
    return D.stale_indexes(import_repositories(t).withColumn("index_version", version), index.PIPELINE_VERSION).select("id")


@query(
    "invalidated_runs",
    f"""SELECT id, CASE WHEN status = 'COMPLETED' AND repository_id IN (SELECT user_id FROM events WHERE value > 80)
      THEN 'STALE' ELSE status END AS status FROM ({SQL_JOBS})""",
)
def invalidated_runs(t):
    jobs = event_jobs(t).withColumn("job_type", F.lit("ANALYSIS"))
    changed = t("events").filter("value > 80").select(F.col("user_id").alias("repository_id"))
    return D.invalidate_runs(jobs, changed).select("id", "status")


@query(
    "reusable_scans",
    """WITH k AS (SELECT source, count(*) AS n, sum(doc_id) AS s FROM documents GROUP BY source)
    SELECT source AS repository_id, s % 2 = 0 AND n % 2 = 0 AS reuse FROM k""",
)
def reusable_scans(t):
    files = t("documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("repository_id"), F.col("source").alias("path"),
        F.col("lang").alias("language"), F.md5("text").alias("hash"),
    )
    keys = SC.scan_keys(files)
    totals = t("documents").groupBy(F.col("source").alias("repository_id")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("s"))
    runs = keys.join(totals, "repository_id").select(
        "repository_id", F.when(F.col("s") % 2 == 0, F.col("scan_key")).otherwise("old").alias("scan_key"),
        F.when(F.col("n") % 2 == 0, "COMPLETED").otherwise("FAILED").alias("status"),
    )
    return SC.reusable_scans(runs, keys).select("repository_id", "reuse")


@query(
    "index_repository",
    f"""SELECT source AS repository_id, count(*) AS total_files, sum(1 + 2 * n)::BIGINT AS total_loc, sum(greatest(n, 1))::BIGINT AS total_chunks,
      count(*) AS python_files FROM (SELECT source, len({SQL_LINES}) AS n FROM documents) GROUP BY source""",
)
def index_repository(t):
    sources = python_sources(t).select(
        F.col("source").alias("repository_id"), F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"),
    )
    tables = index.index_tree(sources, dimensions=64)
    return tables["totals"].select(
        "repository_id", "total_files", "total_loc", "total_chunks", F.try_element_at("languages", F.lit("python")).alias("python_files")
    )


@query(
    "refresh_written",
    """WITH d AS (SELECT source, doc_id % 4 AS m, doc_id FROM documents)
    SELECT source AS repository_id, count(*) FILTER (m = 0) AS unchanged, count(*) FILTER (m = 1) AS updated, count(*) FILTER (m = 2) AS added,
      count(*) FILTER (m = 3) AS deleted, count(*) FILTER (m <> 3) AS files, count(*) FILTER (m <> 3) AS symbols,
      count(DISTINCT CASE WHEN m = 1 THEN 'again' WHEN m <> 3 THEN 'once' END) AS names
    FROM d GROUP BY source""",
)
def refresh_written(t):
    """Index, write, refresh with changed, new and missing files, write to the same store, read back."""
    spark, folder = t.spark, work_path(t.spark, "refreshed")

    def tree(rows, name):
        return rows.select(
            F.col("source").alias("repository_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
            F.concat(F.lit("def "), name, F.lit("():\n    return 1\n")).cast("binary").alias("content"),
        ).withColumn("size", F.octet_length("content").cast("long"))

    docs = t("documents").select("doc_id", "source", (F.col("doc_id") % 4).alias("m"))
    index.write_index(index.index_tree(tree(docs.filter("m <> 2"), F.lit("once")), dimensions=8), folder, 1)
    stored = {name: store.read_current(spark, folder, name, like) for name, like in store.INDEX_TABLES.items()}
    fresh = refresh.refresh_index(stored, tree(docs.filter("m <> 3"), F.when(F.col("m") == 1, "again").otherwise("once")), dimensions=8)
    index.write_index(fresh, folder, 2, docs.select(F.col("source").alias("repository_id")))
    read = lambda name: store.read_current(spark, folder, name, store.INDEX_TABLES[name])
    files = read("files").groupBy("repository_id").agg(F.count("*").alias("files"))
    symbols = read("symbols").groupBy("repository_id").agg(F.count("*").alias("symbols"), F.countDistinct("name").alias("names"))
    return fresh["changes"].join(files, "repository_id", "left").join(symbols, "repository_id", "left").select(
        "repository_id", "unchanged", "updated", "added", "deleted", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "symbols", "names")]
    )


def mixed_corpus(t):
    """Every document three times: as a Python file, a script and a notebook."""
    parts = [("python", "py", python_sources(t)), ("javascript", "js", marked_scripts(t)), ("notebook", "ipynb", notebooks(t))]
    files = None
    for language, suffix, df in parts:
        one = df.join(t("documents").select("doc_id", F.col("source").alias("repository_id")), "doc_id").select(
            "repository_id", F.concat(F.col("doc_id").cast("string"), F.lit("." + suffix)).alias("path"),
            F.lit(language).alias("language"), "text",
        )
        files = one if files is None else files.unionByName(one)
    return files.withColumn("file_id", F.col("path"))


@query(
    "scan_coverage",
    f"""WITH d AS (SELECT source, len({SQL_LINES}) AS n FROM documents)
    SELECT source AS repository_id, (count(*) * 2 + count(*) FILTER (n >= 2))::BIGINT AS scanned_files,
      sum(1 + 2 * n + n + n // 2)::BIGINT AS scanned_loc,
      count(*) FILTER (n < 2) AS unsupported_files, sum(n // 2)::BIGINT AS notebook_cells_scanned,
      0::BIGINT AS notebook_cells_skipped FROM d GROUP BY source""",
)
def scan_coverage(t):
    return scan.scan_files(mixed_corpus(t))["coverage"].select(
        "repository_id", "scanned_files", "scanned_loc", "unsupported_files", "notebook_cells_scanned", "notebook_cells_skipped"
    )
