"""Registered queries: ownership, ledgers, limits, exports, prompt inputs.

`orders` play the import ledger (customer = owner, priority = source, year = revision), `events` the request log.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..functions.rows import each
from ..operators import accounts as A
from ..operators import chunks as C
from ..operators import inventory as N
from ..operators import prompts as P
from ..operators import rate_limits as L
from ..session import work_path
from ..sources import store
from .catalog_tables import SQL_FILES, SQL_ISSUES, corpus_files, event_issues, event_jobs
from .registry import SQL_LINES, query, sql_list

STATUS = {"F": "COMPLETED", "O": "RESERVED", "P": "FAILED"}
OWNER = 3


def admissions(t):
    statuses = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return t("orders").select(
        F.col("o_orderkey").alias("repository_id"), F.col("o_custkey").alias("owner_id"),
        F.col("o_orderpriority").alias("source_key"), F.year("o_orderdate").cast("string").alias("revision"),
        statuses[F.col("o_orderstatus")].alias("status"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice"),
    )


SQL_ADMISSIONS = f"""SELECT o_orderkey AS repository_id, o_custkey AS owner_id, o_orderpriority AS source_key,
    year(o_orderdate)::VARCHAR AS revision, (map({sql_list(STATUS)}, {sql_list(STATUS.values())}))[o_orderstatus] AS status,
    o_orderdate AS created_at, o_totalprice FROM orders"""


@query(
    "quota_usage",
    f"""SELECT owner_id, count(*) FILTER (status = 'COMPLETED') AS used, count(*) FILTER (status = 'RESERVED') AS reserved,
    greatest(0, 10 - count(*) FILTER (status IN ('COMPLETED', 'RESERVED')))::BIGINT AS remaining
    FROM ({SQL_ADMISSIONS}) GROUP BY owner_id""",
)
def quota_usage(t):
    return A.usage(admissions(t))


@query(
    "queue_depth",
    f"""SELECT owner_id, count(*) AS own_pending, (SELECT count(*) FROM ({SQL_ADMISSIONS}) WHERE status = 'RESERVED') AS all_pending,
    (SELECT count(*) FROM ({SQL_ADMISSIONS}) WHERE status = 'RESERVED') >= 10000000 OR count(*) >= 2 AS "full"
    FROM ({SQL_ADMISSIONS}) WHERE status = 'RESERVED' GROUP BY owner_id""",
)
def queue_depth(t):
    return A.queue_depth(admissions(t), total_limit=10_000_000)


@query(
    "queue_over_time",
    """WITH r AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate::TIMESTAMP AS a, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::TIMESTAMP + to_days((o_orderkey % 90)::INT) END AS b FROM orders),
    e AS (SELECT id, owner, a AS t, 1 AS kind, (b IS NULL OR b > a)::INT AS delta FROM r UNION ALL SELECT id, owner, b, 0, -1 FROM r WHERE b > a),
    s AS (SELECT *, coalesce(sum(delta) OVER (ORDER BY t, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS all_pending,
      coalesce(sum(delta) OVER (PARTITION BY owner ORDER BY t, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS own_pending FROM e)
    SELECT id AS repository_id, owner AS owner_id, all_pending, own_pending, all_pending >= 400 OR own_pending >= 2 AS "full" FROM s WHERE kind = 1""",
)
def queue_over_time(t):
    """Orders as reservations that last up to three months; a tenth is never closed."""
    start = F.col("o_orderdate").cast("timestamp")
    days = F.make_dt_interval((F.col("o_orderkey") % 90).cast("int"))
    reservations = t("orders").select(
        F.col("o_orderkey").alias("repository_id"), F.col("o_custkey").alias("owner_id"), start.alias("started_at"),
        F.when(F.col("o_orderkey") % 10 != 0, start + days).alias("ended_at"),
    )
    return A.queue_over_time(reservations, total_limit=400)


def import_repositories(t):
    """Orders as repositories; the price decides how an import ended."""
    price = F.col("o_totalprice")
    return t("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"),
        F.when(price > 150000, "READY").when(price < 60000, "FAILED").otherwise("PARSING").alias("status"),
    )


SQL_REPOSITORIES = """SELECT o_orderkey AS id, o_custkey AS owner_id, CASE WHEN o_totalprice > 150000 THEN 'READY'
    WHEN o_totalprice < 60000 THEN 'FAILED' ELSE 'PARSING' END AS status FROM orders"""


@query(
    "cached_imports",
    f"""WITH q AS (SELECT DISTINCT owner_id, source_key, revision FROM ({SQL_ADMISSIONS})),
    u AS (SELECT a.* FROM ({SQL_ADMISSIONS}) a JOIN ({SQL_REPOSITORIES}) r ON r.id = a.repository_id
      WHERE a.status IN ('RESERVED', 'COMPLETED') AND r.status <> 'FAILED' QUALIFY row_number() OVER (PARTITION BY a.owner_id,
      a.source_key, a.revision ORDER BY a.created_at DESC, a.repository_id DESC) = 1)
    SELECT q.*, u.repository_id AS cached_repository_id FROM q LEFT JOIN u USING (owner_id, source_key, revision)""",
)
def cached_imports(t):
    requests = admissions(t).select("owner_id", "source_key", "revision").distinct()
    return A.cached_imports(requests, admissions(t), import_repositories(t))


@query(
    "changed_revisions",
    f"""WITH a AS ({SQL_ADMISSIONS}) SELECT repository_id FROM a WHERE EXISTS (SELECT 1 FROM a b WHERE b.owner_id = a.owner_id
      AND b.source_key = a.source_key AND b.status = 'COMPLETED' AND b.revision <> a.revision)""",
)
def changed_revisions(t):
    return A.changed_revisions(admissions(t), admissions(t)).select("repository_id")


@query(
    "admission_replay",
    f"""WITH RECURSIVE q AS (SELECT repository_id, owner_id, source_key || '@' || revision AS pair, status = 'FAILED' AS failed,
      row_number() OVER (PARTITION BY owner_id ORDER BY created_at, repository_id) AS n FROM ({SQL_ADMISSIONS})),
    r AS (SELECT repository_id, owner_id, n, CASE WHEN failed THEN []::VARCHAR[] ELSE [pair] END AS held, 'admitted' AS outcome
          FROM q WHERE n = 1
      UNION ALL SELECT q.repository_id, q.owner_id, q.n, CASE WHEN list_contains(r.held, q.pair) OR len(r.held) >= 3 OR q.failed
          THEN r.held ELSE list_append(r.held, q.pair) END,
        CASE WHEN list_contains(r.held, q.pair) THEN 'reused' WHEN len(r.held) < 3 THEN 'admitted' ELSE 'refused' END
      FROM r JOIN q ON q.owner_id = r.owner_id AND q.n = r.n + 1)
    SELECT repository_id, owner_id, outcome FROM r""",
)
def admission_replay(t):
    requests = admissions(t).select(
        "repository_id", "owner_id", "source_key", "revision", (F.col("status") == "FAILED").alias("failed"),
        F.struct("created_at", "repository_id").alias("at"),
    )
    return A.replay_admissions(requests, limit=3).select("repository_id", "owner_id", "outcome")


@query(
    "settled_ledger",
    f"""SELECT a.repository_id, CASE WHEN a.status = 'RESERVED' AND r.status = 'READY' THEN 'COMPLETED'
      WHEN a.status = 'RESERVED' AND r.status = 'FAILED' THEN 'FAILED' ELSE a.status END AS status
    FROM ({SQL_ADMISSIONS}) a JOIN ({SQL_REPOSITORIES}) r ON r.id = a.repository_id""",
)
def settled_ledger(t):
    return A.settle(admissions(t), import_repositories(t)).select("repository_id", "status")


def customer_repositories(t):
    return t("customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("owner_id"),
        F.when(F.col("c_custkey") % 3 != 0, "github").otherwise("zip").alias("source_type"),
        F.when(
            F.col("c_custkey") % 7 != 0,
            F.concat(F.when(F.col("c_custkey") % 2 == 0, "https://GitHub.com/").otherwise("https://gitlab.com/"),
                     F.replace("c_name", F.lit("#"), F.lit("/")), F.lit(".git")),
        ).alias("source_url"),
        F.when(F.col("c_acctbal") > 5000, "READY").when(F.col("c_acctbal") < 0, "FAILED").otherwise("PARSING").alias("status"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


SQL_CUSTOMERS = """SELECT c_custkey::VARCHAR AS id, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey::VARCHAR END AS owner_id,
    CASE WHEN c_custkey % 3 <> 0 THEN 'github' ELSE 'zip' END AS source_type, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0
      THEN 'https://GitHub.com/' ELSE 'https://gitlab.com/' END || replace(c_name, '#', '/') || '.git' END AS source_url,
    CASE WHEN c_acctbal > 5000 THEN 'READY' WHEN c_acctbal < 0 THEN 'FAILED' ELSE 'PARSING' END AS status, c_custkey FROM customer"""


@query(
    "seeded_ledger",
    f"""SELECT id AS repository_id, owner_id, CASE WHEN source_type = 'zip' THEN 'known' WHEN source_type = 'github' AND source_url IS NOT NULL
      THEN CASE WHEN lower(source_url) LIKE 'https://github.com/%' THEN lower(regexp_replace(rtrim(source_url, '/'), '\\.git$', ''))
        ELSE regexp_replace(rtrim(source_url, '/'), '\\.git$', '') END ELSE 'legacy:' || id END AS source_key,
      CASE WHEN source_type = 'zip' THEN 'r' ELSE 'legacy:' || id END AS revision,
      CASE WHEN source_type = 'zip' THEN 'COMPLETED' WHEN status = 'READY' THEN 'COMPLETED' WHEN status = 'FAILED' THEN 'FAILED'
        ELSE 'RESERVED' END AS status FROM ({SQL_CUSTOMERS}) WHERE owner_id IS NOT NULL""",
)
def seeded_ledger(t):
    repos = customer_repositories(t)
    known = repos.filter("source_type = 'zip' and owner_id is not null").select(
        F.col("id").alias("repository_id"), "owner_id", F.lit("known").alias("source_key"), F.lit("r").alias("revision"),
        F.lit("COMPLETED").alias("status"), "created_at",
    )
    once = A.seed_ledger(repos, known)
    return A.seed_ledger(repos, once).drop("created_at")


@query(
    "seeded_owners",
    f"""SELECT DISTINCT owner_id FROM ({SQL_CUSTOMERS}) WHERE owner_id IS NOT NULL""",
)
def seeded_owners(t):
    repos = customer_repositories(t)
    known = repos.filter("owner_id = '7'").select("owner_id").distinct()
    return A.seed_owners(repos, known)


@query(
    "legacy_admissions",
    f"""SELECT id AS repository_id, source_url FROM ({SQL_CUSTOMERS}) WHERE owner_id IS NOT NULL AND status = 'READY'
    AND source_type = 'github'""",
)
def legacy_admissions(t):
    repos = customer_repositories(t)
    empty = A.seed_ledger(repos, repos.limit(0).select(
        F.col("id").alias("repository_id"), "owner_id", F.lit("").alias("source_key"), F.lit("").alias("revision"), "status",
        "created_at",
    ))
    return A.legacy_admissions(repos, empty).select("repository_id", "source_url")


@query(
    "owned_ids",
    f"""SELECT id FROM ({SQL_REPOSITORIES}) WHERE owner_id = {OWNER} UNION
    SELECT repository_id FROM ({SQL_ADMISSIONS}) WHERE owner_id + 1 = {OWNER}""",
)
def owned_ids(t):
    moved = admissions(t).withColumn("owner_id", F.col("owner_id") + 1)
    return A.owned_ids(import_repositories(t), moved, OWNER)


@query(
    "storage_conflicts",
    f"""SELECT repository_id AS id FROM ({SQL_ADMISSIONS}) WHERE owner_id + 1 = {OWNER} AND owner_id <> {OWNER}""",
)
def storage_conflicts(t):
    moved = admissions(t).withColumn("owner_id", F.col("owner_id") + 1)
    ids = A.owned_ids(import_repositories(t), moved, OWNER)
    return A.storage_conflicts(import_repositories(t), ids, OWNER).select("id")


LINKS = {"orders": ("repositories", "o_custkey", "id"), "lineitem": ("orders", "l_orderkey", "o_orderkey")}


def owner_tables(t):
    return dict(
        repositories=t("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner_id"), "c_name"
        ),
        orders=t("orders"), lineitem=t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
    )


SQL_OWNED = f"""l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer
    WHERE c_nationkey = {OWNER}))"""


@query("owned_export", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {SQL_OWNED}")
def owned_export(t):
    return A.owned_tables(owner_tables(t), OWNER, LINKS)["lineitem"]


@query(
    "export_manifest",
    f"""WITH c AS (SELECT 'repositories' AS table_name, count(*) AS row_count FROM customer WHERE c_nationkey = {OWNER}
      UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = {OWNER})
      UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE {SQL_OWNED})
    SELECT *, (SELECT sum(row_count) FROM c)::BIGINT AS total_rows, (SELECT sum(row_count) FROM c) > 200000 AS refused FROM c""",
)
def export_manifest(t):
    return store.export_manifest(A.owned_tables(owner_tables(t), OWNER, LINKS))


def account_tables(t):
    """Repositories per source with files, symbols, findings, jobs, chunks, summaries and chats below them."""
    docs = t("documents").select("doc_id", F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("id"), F.col("lang"))
    owner = F.when(F.col("id").rlike("[02468]$"), "even").otherwise("odd")
    repositories = docs.select(F.col("repository_id").alias("id")).distinct().withColumn("owner_id", owner)
    part = lambda where, *columns: docs.filter(where).select("repository_id", *columns)
    return {
        "repositories": repositories,
        "files": part("true", "id", F.col("lang").alias("language"), F.concat(F.lit("doc"), "id").alias("path")),
        "symbols": part("doc_id % 2 = 0", F.col("id").alias("file_id"), F.lit("f").alias("name"), F.lit("function").alias("type"), F.lit(1).alias("start_line")),
        "code_chunks": part("true", F.concat(F.lit("c"), "id").alias("id")),
        "vectors": part("true", F.concat(F.lit("c"), "id").alias("id")),
        "analysis_issues": part("doc_id % 3 = 0", F.col("id").alias("file_id"), F.lit("LONG_LINE").alias("issue_type"), F.lit(1).alias("line"), F.lit("m").alias("message")),
        "repository_jobs": part("doc_id % 5 = 0", F.concat(F.lit("j"), "id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "ANALYSIS").otherwise("CHAT:1").alias("job_type"),
                                F.struct(F.lit("2").alias("score_version"), F.lit(1).alias("scanned_files")).alias("coverage")),
        "repository_summaries": part("doc_id % 7 = 0", F.concat(F.lit("s"), "id").alias("id"), F.lit("text").alias("content")),
        "conversations": part("doc_id % 11 = 0", F.concat(F.lit("v"), "id").alias("id")),
        "messages": docs.filter("doc_id % 11 = 0").select(F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("v"), "id").alias("conversation_id"), F.lit("hello").alias("content")),
        "analysis_admissions": docs.filter("doc_id % 13 = 0").select("repository_id", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("owner_id"), F.lit("DONE").alias("status")),
    }


@query(
    "account_export",
    """WITH d AS (SELECT doc_id, regexp_matches(source, '[02468]$') AS mine, source FROM documents),
    c AS (SELECT 'repositories' AS table_name, count(DISTINCT source) FILTER (mine) AS row_count FROM d
    UNION ALL SELECT 'files', count(*) FILTER (mine) FROM d UNION ALL SELECT 'symbols', count(*) FILTER (mine AND doc_id % 2 = 0) FROM d
    UNION ALL SELECT 'analysis_issues', count(*) FILTER (mine AND doc_id % 3 = 0) FROM d
    UNION ALL SELECT 'analysis_runs', count(*) FILTER (mine AND doc_id % 10 = 0) FROM d
    UNION ALL SELECT 'summaries', count(*) FILTER (mine AND doc_id % 7 = 0) FROM d
    UNION ALL SELECT 'conversations', count(*) FILTER (mine AND doc_id % 11 = 0) FROM d
    UNION ALL SELECT 'messages', count(*) FILTER (mine AND doc_id % 11 = 0) FROM d
    UNION ALL SELECT 'usage_history', count(*) FILTER (doc_id % 26 = 0) FROM d)
    SELECT table_name, row_count, sum(row_count) OVER ()::BIGINT AS total_rows FROM c""",
)
def account_export(t):
    """The whole chain: what an account owns, cut to what an export shows, written, counted in its manifest."""
    shown = store.export_tables(A.owned_tables(account_tables(t), "even"))
    folder = work_path(t.spark, "export")
    store.write_export(shown, folder, max_rows=None)
    written = t.spark.read.schema("table_name string, row_count long").json(f"{folder}/manifest")
    return written.withColumn("total_rows", F.sum("row_count").over(Window.partitionBy()))


@query("cascade_delete", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT ({SQL_OWNED})")
def cascade_delete(t):
    return A.delete_account(owner_tables(t), OWNER, LINKS)["lineitem"]


@query(
    "owner_scope",
    """SELECT s_suppkey, s_nationkey, n_regionkey AS owner_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE n_regionkey = 2""",
)
def owner_scope(t):
    parents = t("nation").select("n_nationkey", F.col("n_regionkey").alias("owner_id"))
    return A.owned_scope(t("supplier"), parents, "s_nationkey", "n_nationkey", owner=2).select(
        "s_suppkey", "s_nationkey", "owner_id"
    )


@query(
    "symbols_with_path",
    """SELECT l_orderkey AS file_id, l_linenumber AS name, o_orderpriority AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_returnflag = 'R'""",
)
def symbols_with_path(t):
    symbols = t("lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("name"), F.col("l_returnflag").alias("type")
    )
    files = t("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repository_id"), F.col("o_orderpriority").alias("path")
    )
    return N.symbols_with_path(symbols, files, kind="R").select("file_id", "name", "path")


@query(
    "symbol_outline",
    """WITH s AS (SELECT o_orderkey AS id, o_custkey AS file_id, o_orderpriority AS name, CASE o_orderstatus WHEN 'F' THEN 'class'
      WHEN 'O' THEN 'method' ELSE 'function' END AS type FROM orders),
    c AS (SELECT DISTINCT file_id, name FROM s WHERE type = 'class')
    SELECT s.id, CASE WHEN type = 'class' THEN s.name WHEN type = 'method' AND c.name IS NOT NULL THEN s.name ELSE '(functions)' END
      AS listed_under FROM s LEFT JOIN c ON c.file_id = s.file_id AND c.name = s.name""",
)
def symbol_outline(t):
    kind = F.when(F.col("o_orderstatus") == "F", "class").when(F.col("o_orderstatus") == "O", "method").otherwise("function")
    symbols = t("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("name"),
        kind.alias("type"), F.when(kind != "class", F.col("o_orderpriority")).alias("parent_name"),
    )
    return N.symbol_outline(symbols).select("id", "listed_under")


@query(
    "conversations_active",
    """SELECT conv_id::VARCHAR AS id, max(turn) AS updated_at, bool_or(turn = m AND role = 'user') AS is_generating
    FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id""",
)
def conversations_active(t):
    turns = t("conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("updated_at"), F.max_by("role", "turn").alias("role"))
    jobs = last.select(
        F.concat(F.lit("CHAT:"), F.col("conv_id").cast("string")).alias("job_type"),
        F.when(F.col("role") == "user", "RUNNING").otherwise("COMPLETED").alias("status"),
    )
    return A.conversations_active(last.select(F.col("conv_id").cast("string").alias("id"), "updated_at"), jobs)


@query(
    "busy_stalled",
    """SELECT count(*) AS busy, count(*) FILTER (ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 15 MINUTE) AS stalled
    FROM events WHERE event_type = 'view' AND event_id % 40 = 0""",
)
def busy_stalled(t):
    jobs = event_jobs(t).withColumn("updated_at", F.col("created_at"))
    return A.busy_and_stalled(jobs, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query(
    "recovered_jobs",
    f"""SELECT event_id AS id, CASE WHEN event_type = 'view' AND event_id % 40 = 0 THEN 'FAILED' WHEN event_type = 'error' THEN 'FAILED'
      WHEN event_type = 'purchase' THEN 'COMPLETED' ELSE 'STALE' END AS status, CASE WHEN event_type = 'view' AND event_id % 40 = 0
      THEN CASE WHEN user_id % 2 = 0 THEN '{V.INTERRUPTED["CHAT"]}' ELSE '{V.INTERRUPTED["ANALYSIS"]}' END END AS error_message FROM events""",
)
def recovered_jobs(t):
    jobs = event_jobs(t).withColumns(
        {
            "job_type": F.when(F.col("repository_id") % 2 == 0, F.concat(F.lit("CHAT:"), F.col("id").cast("string"))).otherwise("ANALYSIS"),
            "error_message": F.lit(None).cast("string"),
        }
    )
    return A.recover_jobs(jobs).select("id", "status", "error_message")


SQL_LIMITER = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
      FROM events),
    r AS (SELECT event_id, user_id, n, [t] AS log, true AS accepted, 0::BIGINT AS retry_after FROM e WHERE n = 1
      UNION ALL SELECT event_id, user_id, n, CASE WHEN len(keep) < 2 THEN list_append(keep, t) ELSE keep END, len(keep) < 2,
        CASE WHEN len(keep) < 2 THEN 0 ELSE greatest(1, ceil((keep[1] + 86400000000 - t) / 1000000.0))::BIGINT END
      FROM (SELECT e.event_id, e.user_id, e.n, e.t, list_filter(r.log, lambda x: x > e.t - 86400000000) AS keep
            FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT event_id, user_id, accepted, retry_after FROM r"""


@query("rate_limit", SQL_LIMITER)
def rate_limit(t):
    return L.replay_limits(t("events"), "user_id", "ts", "event_id", limit=2, seconds=86400)


@query(
    "rate_groups",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 'all,import' WHEN 'error' THEN 'all,ai-day,ai' WHEN 'click' THEN 'all,search'
      WHEN 'view' THEN 'all' ELSE 'all,scan' END AS groups FROM events""",
)
def rate_groups(t):
    kind = F.col("event_type")
    path = (
        F.when(kind == "signup", "/repositories/upload").when(kind == "error", F.concat(F.lit("/generate/"), F.col("event_id").cast("string")))
        .when(kind == "click", "/search").when(kind == "view", F.concat(F.lit("/analysis/"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("/repositories/"), F.col("user_id").cast("string"), F.lit("/reindex")))
    )
    method = F.when(kind == "view", "GET").otherwise("POST")
    return t("events").select("event_id", F.array_join(L.rate_groups(method, path), ",").alias("groups"))


# --- prompt inputs: documents are files, their lines are symbols, blocks of ten lines are chunks -------------------

KINDS = ["class", "function", "method"]


def line_symbols(t):
    files = t("documents").withColumnRenamed("doc_id", "file_id")
    rows = each(files, X.split_lines(F.col("text")), "docstring", ["file_id"], position="i")
    n = F.col("i") + 1
    return rows.select(
        "file_id", F.concat(F.lit("n"), (n % 5).cast("string")).alias("name"),
        F.get(F.array(*[F.lit(k) for k in KINDS]), n % 3).alias("type"), n.alias("start_line"), n.alias("end_line"),
        F.when(n % 3 == 2, "Owner").alias("parent_name"), F.concat(F.lit("sig"), n.cast("string")).alias("signature"),
        "docstring",
    )


SQL_SYMBOLS = f"""SELECT file_id, 'n' || (i % 5) AS name, ({sql_list(KINDS)})[(i % 3 + 1)::INT] AS type, i AS start_line, i AS end_line,
    CASE WHEN i % 3 = 2 THEN 'Owner' END AS parent_name, 'sig' || i AS signature, docstring FROM (
      SELECT doc_id AS file_id, unnest({SQL_LINES}) AS docstring, generate_subscripts({SQL_LINES}, 1) AS i FROM documents)"""


def block_chunks(t):
    files = t("documents").select(F.col("doc_id").alias("file_id"), "lang", X.split_lines(F.col("text")).alias("lines"))
    rows = C.explode_chunks(files, C.line_blocks(F.col("lines"), 10), ["file_id", "lang"])
    return rows.select(
        "file_id", "chunk_index", "content", "start_line", "end_line",
        F.concat(F.lit("n"), (F.col("chunk_index") % 5).cast("string")).alias("symbol_name"),
        F.when(F.col("lang") == "en", "json").otherwise("python").alias("language"),
    )


SQL_BLOCKS = f"""SELECT file_id, chunk_index, content, a AS start_line, z AS end_line, 'n' || (chunk_index % 5) AS symbol_name,
      CASE WHEN lang = 'en' THEN 'json' ELSE 'python' END AS language FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY a) - 1 AS chunk_index FROM (
      SELECT file_id, lang, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS content FROM (
        SELECT doc_id AS file_id, lang, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents)
      GROUP BY file_id, lang, (i - 1) // 10) WHERE regexp_matches(content, '\\S'))"""


@query(
    "repository_prompt",
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY importance_score DESC, path) AS i FROM
      (SELECT *, coalesce(importance_level, 'LOW') AS lvl FROM ({SQL_FILES})))
    SELECT repository_id, string_agg('- ' || path || ' (importance: ' || lvl || ', ' || num_classes || ' classes, ' || num_functions
      || ' functions)', chr(10) ORDER BY i) AS important_files FROM f WHERE i <= 15 GROUP BY repository_id""",
)
def repository_prompt(t):
    files = corpus_files(t).withColumn("importance_level", F.coalesce("importance_level", F.lit("LOW")))
    return P.important_file_lines(files)


@query(
    "readme_tree",
    f"""SELECT repository_id, path, '      doc' || id || '.py (' || language || ', ' || loc || ' LOC)' AS line FROM ({SQL_FILES})""",
)
def readme_tree(t):
    return P.tree_lines(corpus_files(t)).select("repository_id", "path", "line")


@query(
    "readme_components",
    f"""WITH f AS (SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id ORDER BY importance_score DESC, path) AS file_rank
      FROM ({SQL_FILES}) QUALIFY file_rank <= 10),
    s AS (SELECT f.repository_id, s.*, row_number() OVER (PARTITION BY f.repository_id ORDER BY file_rank, start_line, name) AS position
      FROM ({SQL_SYMBOLS}) s JOIN f ON f.id = s.file_id QUALIFY position <= 20)
    SELECT repository_id, position::INT AS position, '- `' || name || '` (' || type || ')' || CASE WHEN docstring <> ''
      THEN ': ' || left(docstring, 80) ELSE '' END AS line FROM s WHERE type IN ('class', 'function')""",
)
def readme_components(t):
    return P.key_components(corpus_files(t), line_symbols(t))


@query(
    "readme_issues",
    f"""SELECT repository_id, '- Critical: ' || count(*) FILTER (severity = 'CRITICAL') || chr(10) || '- High: ' || count(*) FILTER
      (severity = 'HIGH') || chr(10) || '- Medium: ' || count(*) FILTER (severity = 'MEDIUM') || chr(10) || '- Low: ' || count(*) FILTER
      (severity = 'LOW') AS issue_lines FROM ({SQL_ISSUES}) GROUP BY repository_id""",
)
def readme_issues(t):
    return P.severity_lines(event_issues(t))


@query(
    "architecture_prompt",
    f"""SELECT repository_id, importance_level AS section, path, CASE WHEN importance_level = 'HIGH' THEN '- ' || path || ' (score: '
      || format('{{:.1f}}', importance_score) || ', classes: ' || num_classes || ', functions: ' || num_functions || ')' || chr(10) || '  Summary: '
      || id ELSE '- ' || path || ' (score: ' || format('{{:.1f}}', importance_score) || ')' END AS line
    FROM ({SQL_FILES}) WHERE importance_level IN ('HIGH', 'MEDIUM')""",
)
def architecture_prompt(t):
    files = corpus_files(t).withColumn("summary", F.col("id").cast("string"))
    return P.architecture_lines(files).select("repository_id", "section", "path", "line")


@query(
    "api_prompt",
    f"""WITH s AS (SELECT f.repository_id, f.path, s.*, row_number() OVER (PARTITION BY f.repository_id ORDER BY f.path, start_line, name) AS i
      FROM ({SQL_SYMBOLS}) s JOIN (SELECT * FROM ({SQL_FILES}) WHERE importance_level = 'HIGH') f ON f.id = s.file_id)
    SELECT repository_id, string_agg('File: ' || path || chr(10) || '  ' || type || ': ' || name || chr(10) || '  Signature: ' || signature
      || chr(10) || '  Docs: ' || CASE WHEN docstring <> '' THEN left(docstring, 100) ELSE 'None' END || chr(10), chr(10) ORDER BY i)
      AS components FROM s WHERE i <= 25 GROUP BY repository_id""",
)
def api_prompt(t):
    return P.api_doc_input(corpus_files(t), line_symbols(t))


@query(
    "file_prompt",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_line, name) AS i FROM ({SQL_SYMBOLS})),
    l AS (SELECT file_id, string_agg('- ' || type || ': ' || name || CASE WHEN parent_name IS NOT NULL THEN ' (in ' || parent_name || ')'
      ELSE '' END, chr(10) ORDER BY i) AS symbol_list FROM s WHERE i <= 20 GROUP BY file_id),
    c AS (SELECT file_id, left(string_agg(symbol_name || ':' || chr(10) || content, chr(10) ORDER BY chunk_index), 1000) AS sample_code
      FROM ({SQL_BLOCKS}) WHERE language = 'json' AND chunk_index < 4 GROUP BY file_id)
    SELECT f.id AS file_id, f.path, coalesce(nullif(symbol_list, ''), 'None') AS symbol_list, 'None' AS import_list, sample_code
    FROM ({SQL_FILES}) f LEFT JOIN l ON l.file_id = f.id LEFT JOIN c ON c.file_id = f.id""",
)
def file_prompt(t):
    files = corpus_files(t).withColumns(
        {"hash": F.col("path"), "imports": F.array().cast("array<struct<module:string,line:int>>")}
    )
    return P.file_summary_input(files, line_symbols(t), block_chunks(t)).select(
        "file_id", "path", "symbol_list", "import_list", "sample_code"
    )


@query(
    "pending_summaries",
    f"""SELECT id AS file_id FROM ({SQL_FILES}) WHERE importance_level = 'HIGH'""",
)
def pending_summaries(t):
    files = corpus_files(t).withColumns(
        {"hash": F.col("path"), "imports": F.array().cast("array<struct<module:string,line:int>>")}
    )
    inputs = P.file_summary_input(files, line_symbols(t), block_chunks(t))
    known = t("labels").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("summary_key"))
    return P.pending_file_summaries(inputs, files, known, "v1").select("file_id")


@query(
    "symbol_test_prompt",
    f"""WITH q AS (SELECT doc_id AS request_id, doc_id AS file_id, 'n' || (doc_id % 6) AS symbol_name FROM documents),
    m AS (SELECT q.request_id, q.file_id, s.name, s.start_line, s.end_line, s.signature FROM q JOIN ({SQL_SYMBOLS}) s ON s.file_id = q.file_id AND s.name = q.symbol_name),
    n AS (SELECT q.request_id, count(m.name) AS c FROM q LEFT JOIN m ON m.request_id = q.request_id GROUP BY ALL),
    o AS (SELECT m.* FROM m JOIN n USING (request_id) WHERE n.c = 1),
    w AS (SELECT * FROM ({SQL_BLOCKS}) WHERE chunk_index < 5),
    code AS (SELECT o.request_id, left(string_agg(b.content, chr(10) ORDER BY chunk_index), 12000) AS function_code FROM o JOIN ({SQL_BLOCKS}) b
      ON b.file_id = o.file_id AND b.symbol_name = o.name AND b.start_line >= o.start_line AND b.end_line <= o.end_line GROUP BY ALL),
    rel AS (SELECT request_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS related_code FROM (
      SELECT o.request_id, w.content, w.chunk_index, row_number() OVER (PARTITION BY o.request_id ORDER BY w.chunk_index) AS i
      FROM o JOIN w ON w.file_id = o.file_id AND w.symbol_name <> o.name) WHERE i <= 3 GROUP BY request_id)
    SELECT q.request_id, o.signature, code.function_code, rel.related_code, CASE WHEN n.c = 0 THEN 'Symbol not found in this file'
      WHEN n.c > 1 THEN 'Select a specific symbol ID for an overloaded name' END AS error
    FROM q LEFT JOIN n USING (request_id) LEFT JOIN o USING (request_id) LEFT JOIN code USING (request_id) LEFT JOIN rel USING (request_id)""",
)
def symbol_test_prompt(t):
    requests = t("documents").select(
        F.col("doc_id").alias("request_id"), F.col("doc_id").alias("file_id"),
        F.concat(F.lit("n"), (F.col("doc_id") % 6).cast("string")).alias("symbol_name"),
        F.lit(None).cast("int").alias("symbol_line"),
    )
    return P.symbol_test_input(requests, corpus_files(t), line_symbols(t), block_chunks(t)).select(
        "request_id", "signature", "function_code", "related_code", "error"
    )


@query(
    "file_test_prompt",
    f"""WITH l AS (SELECT file_id, string_agg('- ' || type || ': ' || name || '(' || signature || ')', chr(10) ORDER BY start_line) AS symbol_list,
      count(*) AS symbols_count FROM ({SQL_SYMBOLS}) GROUP BY file_id),
    c AS (SELECT file_id, left(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index), 3000) AS code FROM ({SQL_BLOCKS}) GROUP BY file_id)
    SELECT f.id AS file_id, symbol_list, coalesce(symbols_count, 0) AS symbols_count, code FROM ({SQL_FILES}) f
    LEFT JOIN l ON l.file_id = f.id LEFT JOIN c ON c.file_id = f.id""",
)
def file_test_prompt(t):
    return P.file_test_input(corpus_files(t), line_symbols(t), block_chunks(t)).select(
        "file_id", "symbol_list", "symbols_count", "code"
    )
