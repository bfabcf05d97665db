"""Registered queries over the store of changes."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from ..operators import vectors as VE
from ..session import work_path
from ..sources import changes, store
from ..streaming import jobs as J
from ..streaming.runner import read_table_stream, run_batches
from .catalog_search import sql_unit, word_buckets
from .registry import SQL_LINES, query, stream_query

N_BATCHES = 5


def change_log(documents):
    """Documents as files that come in five batches; in the batch after its own a third is revised and a seventh goes."""
    own = F.col("doc_id") % N_BATCHES
    text, later = F.coalesce("text", F.lit("")), (own < N_BATCHES - 1)
    event = lambda after, content: F.struct((own + after).alias("batch"), content.cast("binary").alias("content"))
    events = F.array(
        event(F.lit(0), text), F.when(later & (F.col("doc_id") % 3 == 0), event(F.lit(1), F.concat(text, F.lit("\nrevised")))),
        F.when(later & (F.col("doc_id") % 7 == 0), event(F.lit(1), F.lit(None))),
    )
    return documents.select(
        F.col("source").alias("repository_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".go")).alias("path"),
        F.posexplode(events).alias("seq", "e"),
    ).filter("e is not null").select("repository_id", "path", "seq", "e.batch", "e.content", F.octet_length("e.content").cast("long").alias("size"))


#: The files that the log leaves in force, and their chunks of 150 lines.
SQL_IN_FORCE = f"""f AS (SELECT doc_id, source AS repository_id, 'doc' || doc_id || '.go' AS path, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 < 4
      THEN coalesce(text, '') || chr(10) || 'revised' ELSE coalesce(text, '') END AS text FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 5 < 4)),
    g AS (SELECT * FROM f WHERE octet_length(encode(text)) <= 1048576),
    l AS (SELECT path, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM g),
    c AS (SELECT path, (i - 1) // 150 AS block, min(i) AS a, string_agg(line, chr(10) ORDER BY i) AS content FROM l GROUP BY ALL HAVING regexp_matches(content, '\\S'))"""


@stream_query(
    "changes_folded",
    f"""WITH {SQL_IN_FORCE},
    v AS (SELECT path, {sql_unit("'File: ' || path || chr(10) || 'Symbol:  (file_chunk)' || chr(10) || chr(10) || content")} AS v FROM c),
    n AS (SELECT path, count(*) AS chunks, round(sum(list_sum(list_transform(v, lambda x, i: i * (x / sqrt(list_dot_product(v, v)))::FLOAT))), 2) AS vector_sum
      FROM v GROUP BY path)
    SELECT repository_id, path, sha256(text) AS hash, len({SQL_LINES})::INT AS loc, coalesce(chunks, 0)::BIGINT AS chunks, coalesce(chunks, 0)::BIGINT AS vectors,
      coalesce(vector_sum, 0)::DOUBLE AS vector_sum FROM g LEFT JOIN n USING (path)""",
)
def changes_folded(spark, sf_dir):
    """Files that arrive, change and vanish in a stream of several batches, appended as changes, folded and read back."""
    folder = work_path(spark, "changes")
    log = change_log(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for n in range(N_BATCHES):  # files of a folder arrive in the order in which they were written
        log.filter(F.col("batch") == n).repartition(2).write.mode("append").parquet(f"{folder}/log")
    arrivals = read_table_stream(spark, f"{folder}/log", files_per_trigger=2)
    run_batches(arrivals, J.index_changes(f"{folder}/store", "seq", compact_every=3, embedder=word_buckets), folder=folder)
    read = lambda name: changes.read(spark, f"{folder}/store", name, store.INDEX_TABLES[name])
    chunks = read("code_chunks").groupBy("repository_id", F.col("file_path").alias("path")).agg(F.count("*").alias("chunks"))
    weighed = F.aggregate(F.transform("embedding", lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    vectors = read("vectors").groupBy("repository_id", F.col("file_path").alias("path")).agg(
        F.count("*").alias("vectors"), F.round(F.sum(weighed), 2).alias("vector_sum")
    )
    none = F.lit(0).cast("long")
    return (
        read("files").join(chunks, ["repository_id", "path"], "left").join(vectors, ["repository_id", "path"], "left")
        .select(
            "repository_id", "path", "hash", "loc", F.coalesce("chunks", none).alias("chunks"), F.coalesce("vectors", none).alias("vectors"),
            F.coalesce("vector_sum", F.lit(0.0)).alias("vector_sum"),
        )
    )


FINDING = "repository_id string, doc_id long, line int, marker string"


def markers(files, word):
    """A finding per line that holds the word."""
    lines = files.select("repository_id", "doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("line", "text"))
    return lines.filter(F.contains("text", F.lit(word))).select(
        "repository_id", "doc_id", (F.col("line") + 1).cast("int").alias("line"), F.lit(word).alias("marker")
    )


@query(
    "findings_replaced",
    f"""WITH l AS (SELECT source, doc_id, lang, unnest({SQL_LINES}) AS line, generate_subscripts({SQL_LINES}, 1) AS i FROM documents)
    SELECT source AS repository_id, doc_id, i::INT AS line, 'th' AS marker FROM l WHERE contains(line, 'th') AND lang = 'en'
    UNION ALL SELECT source, doc_id, i::INT, 'sch' FROM l WHERE contains(line, 'sch') AND lang <> 'en'""",
)
def findings_replaced(t):
    """Findings of a first scan, of which a second one replaces those of all English files, whether it finds any or not."""
    spark, folder = t.spark, work_path(t.spark, "findings")
    files = t("documents").select(F.col("source").alias("repository_id"), "doc_id", "lang", "text")
    key = {"findings": F.col("doc_id").cast("string")}
    english = files.filter("lang = 'en'")
    changes.commit(spark, folder, 1, files.select(F.col("doc_id").alias("key")), {"findings": markers(files, "sch")}, key)
    changes.compact(spark, folder, {"findings": FINDING})
    for _ in range(2):  # the second time is a repeated attempt
        changes.commit(spark, folder, 2, english.select(F.col("doc_id").alias("key")), {"findings": markers(english, "th")}, key)
    return changes.read(spark, folder, "findings", FINDING)


@query(
    "stored_vector_search",
    f"""WITH {SQL_IN_FORCE},
    v AS MATERIALIZED (SELECT path, a, {sql_unit("'File: ' || path || chr(10) || 'Symbol:  (file_chunk)' || chr(10) || chr(10) || content")} AS v FROM c),
    u AS MATERIALIZED (SELECT path, a, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE) AS u FROM v),
    q AS MATERIALIZED (SELECT item_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS q FROM (SELECT item_id, {sql_unit("text")} AS v FROM benchmark)),
    s AS (SELECT item_id, path, a, round(list_dot_product(u, q), 12) AS cos FROM u, q)
    SELECT item_id AS question_id, row_number() OVER (PARTITION BY item_id ORDER BY cos DESC, path, a)::INT AS rank, path, a::INT AS start_line, round(cos, 4) AS score
    FROM s QUALIFY rank <= 5""",
)
def stored_vector_search(t):
    """Questions against the vectors that a store of changes holds after arrivals, revisions and removals."""
    spark, folder = t.spark, work_path(t.spark, "stored-vectors")
    handle = J.index_changes(folder, "seq", embedder=word_buckets)
    log = change_log(t("documents"))
    for n, part in enumerate(["batch <= 2", "batch > 2"]):
        handle(log.filter(part), n)
    vectors = changes.read(spark, folder, "vectors", store.INDEX_TABLES["vectors"])
    asked = VE.embed(R.question_terms(t("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))), "question", embedder=word_buckets)
    place = F.concat_ws("\x01", "file_path", F.lpad(F.col("start_line").cast("string"), 9, "0"))  # its order breaks ties
    hits = VE.vector_search_many(vectors.select(place.alias("id"), "embedding"), asked, 5, "id", "question_id")
    parts = F.split("id", "\x01")
    return hits.select("question_id", "rank", parts[0].alias("path"), parts[1].cast("int").alias("start_line"), "score")
