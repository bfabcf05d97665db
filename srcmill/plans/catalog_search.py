"""Registered queries: vector search, keyword candidates, reranking, contexts, chat messages.

`pages` are the chunks (title = symbol name, url = path, html = content), `benchmark` holds the questions.
"""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import vectors as VE
from ..operators.running import first_per_group
from ..session import cut_lineage, work_path
from ..sources import store
from .registry import SQL_LINES, query, sql_in

SQL_DOT = "list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def first_vector(t):
    return t("embeddings").filter("vec_id = 0").first()["embedding"]


@query(
    "vector_topk",
    f"""SELECT v.vec_id, v.label, round(round({SQL_DOT}, 12), 4) AS score FROM embeddings v,
    (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round({SQL_DOT}, 12) DESC, v.vec_id LIMIT 30""",
)
def vector_topk(t):
    return VE.vector_search(t("embeddings"), first_vector(t), V.VECTOR_HITS, "vec_id")


@query(
    "vector_topk_filtered",
    f"""SELECT v.vec_id, v.label, round(round({SQL_DOT}, 12), 4) AS score FROM embeddings v,
    (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.label = 3
    ORDER BY round({SQL_DOT}, 12) DESC, v.vec_id LIMIT 10""",
)
def vector_topk_filtered(t):
    return VE.vector_search(t("embeddings"), first_vector(t), 10, "vec_id", where="label = 3")


def label_means(t):
    """One query vector per label: the mean of all its vectors."""
    parts = t("embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("mean"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "mean")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["mean"]).alias("embedding"))


SQL_MEANS = """SELECT label, list(a ORDER BY i) AS embedding FROM (SELECT label, i, avg(e) AS a FROM (
    SELECT label, unnest(embedding::DOUBLE[]) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label"""


@query(
    "vector_topk_batch",
    f"""SELECT q.label, v.vec_id, row_number() OVER (PARTITION BY q.label ORDER BY round({SQL_DOT}, 12) DESC, v.vec_id)::INT AS rank,
      round(round({SQL_DOT}, 12), 4) AS score FROM embeddings v, ({SQL_MEANS}) q QUALIFY rank <= 8""",
)
def vector_topk_batch(t):
    return VE.vector_search_many(
        t("embeddings").select("vec_id", "embedding"), label_means(t), 8, "vec_id", "label"
    ).select("label", "vec_id", "rank", "score")


@query(
    "vector_topk_scoped",
    f"""SELECT q.label, v.vec_id, row_number() OVER (PARTITION BY q.label ORDER BY round({SQL_DOT}, 12) DESC, v.vec_id)::INT AS rank,
      round(round({SQL_DOT}, 12), 4) AS score FROM embeddings v JOIN ({SQL_MEANS}) q ON v.label = q.label QUALIFY rank <= 8""",
)
def vector_topk_scoped(t):
    queries = label_means(t).withColumn("query_id", F.col("label"))
    return VE.vector_search_many(t("embeddings"), queries, 8, "vec_id", "query_id", scope="label").select(
        F.col("query_id").alias("label"), "vec_id", "rank", "score"
    )


@query(
    "vector_maintenance",
    """SELECT 'src' || (vec_id % 7) AS repository_id, count(*) AS vectors FROM embeddings
    WHERE vec_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL""",
)
def vector_maintenance(t):
    stored = t("embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("src"), (F.col("vec_id") % 7).cast("string")).alias("repository_id")
    )
    return store.count_vectors(store.delete_vectors(stored, t("labels").select(F.col("doc_id").alias("id"))))


@query(
    "embedding_texts",
    """SELECT doc_id, sha256(('File: ' || source || chr(10) || 'Symbol: ' || lang || ' ()' || chr(10) || chr(10) || text)) AS digest
    FROM documents""",
)
def embedding_texts(t):
    text = VE.embedding_text(F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text"))
    return t("documents").select("doc_id", F.sha2(text, 256).alias("digest"))


@query(
    "embedded_corpus",
    """SELECT doc_id, 64 AS dimensions, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
    FROM documents""",
)
def embedded_corpus(t):
    out = VE.embed(t.spread("documents").select("doc_id", "text"), "text", dimensions=64)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return out.select("doc_id", F.size("embedding").alias("dimensions"), F.round(norm, 4).alias("norm"))


TITLE = "<title>(.*?)</title>"


def page_chunks(t):
    return t.spread("pages").select(
        F.col("page_id").alias("id"), F.lit("pages").alias("repository_id"), F.col("url").alias("file_path"),
        F.regexp_extract("html", TITLE, 1).alias("symbol_name"),
        F.when(F.col("page_id") % 3 == 0, "function").otherwise("page").alias("symbol_type"),
        F.lit("html").alias("language"), F.lit(1).alias("start_line"), X.count_lines(F.col("html")).alias("end_line"),
        F.col("html").alias("content"),
    )


def kept_chunks(t):
    """The chunks as a table that is read several times, a few columns at a time."""
    folder = work_path(t.spark, "page-chunks")
    page_chunks(t).write.parquet(folder)
    return t.spark.read.parquet(folder)


def page_questions(t):
    asked = t("benchmark").select(
        F.col("item_id").alias("question_id"), F.lit("pages").alias("repository_id"), F.col("text").alias("question")
    )
    return R.question_terms(asked)


SQL_TERMS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"
SQL_CANDIDATES = f"""SELECT DISTINCT item_id AS question_id, page_id AS id FROM (
    SELECT item_id, unnest({SQL_TERMS}) AS term FROM benchmark) b, pages p
    WHERE length(term) > 3 AND (contains(lower(regexp_extract(html, '{TITLE}', 1)), term) OR contains(lower(url), term))"""


@query("keyword_candidates", SQL_CANDIDATES)
def keyword_candidates(t):
    return R.keyword_candidates(page_chunks(t), page_questions(t)).select("question_id", "id")


SQL_RANKED = f"""WITH c AS ({SQL_CANDIDATES}), b AS (SELECT item_id, unnest({SQL_TERMS}) AS term FROM benchmark),
    k AS (SELECT item_id, term FROM b WHERE term NOT IN {sql_in(V.STOP_WORDS)}),
    p AS (SELECT page_id, lower(html) AS content, lower(regexp_extract(html, '{TITLE}', 1)) AS symbol, lower(url) AS path FROM pages),
    s AS (SELECT question_id, id, round(0.3 + count(*) FILTER (contains(content, term)) * 0.05
        + count(*) FILTER (contains(symbol, term)) * 0.1 + count(*) FILTER (contains(path, term)) * 0.08
        + CASE WHEN id % 3 = 0 THEN 0.03 ELSE 0 END, 9)::DOUBLE AS final_score
      FROM c LEFT JOIN k ON k.item_id = c.question_id JOIN p ON p.page_id = c.id GROUP BY question_id, id)
    SELECT question_id, id, final_score, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, id)::INT AS rank
    FROM s QUALIFY rank <= 8"""


@query("rerank", SQL_RANKED)
def rerank(t):
    ranked = R.rank_keyword_candidates(kept_chunks(t), page_questions(t), V.CONTEXT_HITS)
    return ranked.select("question_id", "id", "final_score", "rank")


@query("rerank_indexed", SQL_RANKED)
def rerank_indexed(t):
    """The same with stored postings of the contents, which leave few contents to read."""
    chunks, folder = kept_chunks(t), work_path(t.spark, "postings")
    R.content_postings(chunks).write.parquet(folder)
    ranked = R.rank_keyword_candidates(chunks, page_questions(t), V.CONTEXT_HITS, postings=t.spark.read.parquet(folder))
    return ranked.select("question_id", "id", "final_score", "rank")


def retrieve(chunks, questions, n_initial=V.VECTOR_HITS, n_final=V.CONTEXT_HITS, dimensions=128, embedder=None):
    """Vector and keyword hits of all questions, reranked: (repository_id, question_id, id, final_score, rank)."""
    text = VE.embedding_text(F.col("file_path"), F.col("symbol_name"), F.col("symbol_type"), F.col("content"))
    stored = VE.embed(chunks.select("id", "repository_id", text.alias("_text")), "_text", dimensions, embedder)
    asked = VE.embed(questions, "question", dimensions, embedder)
    hits = VE.vector_search_many(
        stored.select("id", "repository_id", "embedding"), asked, n_initial, "id", "question_id", scope="repository_id"
    ).join(questions.select("question_id", "repository_id"), "question_id")
    # the hits are small and used twice, the search over all vectors should run once
    hits = cut_lineage(hits)
    near = R.rerank(
        hits.withColumnRenamed("rank", "vector_rank"), chunks.join(hits.select("id").distinct(), "id", "left_semi"),
        questions, n_final,
    )
    # at most n_initial of a question's keyword candidates can be vector hits as well
    words = R.rank_keyword_candidates(chunks, questions, n_final + n_initial)
    words = R.exclude_retrieved(words, hits).withColumn("vector_rank", F.lit(None).cast("int"))
    return R.best_of(near.drop("rank").unionByName(words.drop("rank")), n_final)


def word_buckets(text):
    """A plug-in embedding that SQL can repeat: unit vector of word counts in 64 hash buckets."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % 64)
    counts = X.bind(
        buckets,
        lambda b: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")),
    )
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return X.bind(counts, lambda c: X.bind(length(c), lambda n: F.transform(c, lambda x: F.try_divide(x, n))))


def sql_unit(text):
    """The same embedding of a text in SQL, as a subquery column."""
    words = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"
    buckets = f"list_transform({words}, lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 64)"
    return f"list_transform(range(64), lambda i: len(list_filter({buckets}, lambda x: x = i))::DOUBLE)"


SQL_HYBRID = f"""WITH p AS MATERIALIZED (SELECT page_id, html, url, regexp_extract(html, '{TITLE}', 1) AS title,
        CASE WHEN page_id % 3 = 0 THEN 'function' ELSE 'page' END AS kind FROM pages),
    pv AS MATERIALIZED (SELECT page_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT page_id,
        {sql_unit("'File: ' || url || chr(10) || 'Symbol: ' || title || ' (' || kind || ')' || chr(10) || chr(10) || html")} AS v FROM p)),
    qv AS MATERIALIZED (SELECT item_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT item_id,
        {sql_unit("text")} AS v FROM benchmark)),
    hits AS MATERIALIZED (SELECT item_id AS question_id, page_id AS id, round(c, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY c DESC,
        page_id) AS vr FROM (SELECT item_id, page_id, round(list_dot_product(pv.v, qv.v), 12) AS c FROM pv, qv) QUALIFY vr <= 30),
    c AS MATERIALIZED (SELECT * FROM hits UNION ALL SELECT question_id, id, 0.3, NULL FROM ({SQL_CANDIDATES}) k WHERE NOT EXISTS (
        SELECT 1 FROM hits h WHERE h.question_id = k.question_id AND h.id = k.id)),
    t AS (SELECT item_id, term FROM (SELECT item_id, unnest({SQL_TERMS}) AS term FROM benchmark) WHERE term NOT IN {sql_in(V.STOP_WORDS)}),
    s AS (SELECT question_id, id, any_value(vr) AS vr, round(any_value(score) + count(*) FILTER (contains(lower(html), term)) * 0.05
        + count(*) FILTER (contains(lower(title), term)) * 0.1 + count(*) FILTER (contains(lower(url), term)) * 0.08
        + CASE WHEN id % 3 = 0 THEN 0.03 ELSE 0 END, 9)::DOUBLE AS final_score
      FROM c JOIN p ON p.page_id = c.id LEFT JOIN t ON t.item_id = c.question_id GROUP BY question_id, id)
    SELECT question_id, id, final_score, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, vr NULLS LAST, id)::INT AS rank
    FROM s QUALIFY rank <= 8"""


@query("hybrid_retrieval", SQL_HYBRID)
def hybrid_retrieval(t):
    ranked = retrieve(kept_chunks(t), page_questions(t), embedder=word_buckets)
    return ranked.select("question_id", "id", "final_score", "rank")


@query(
    "retrieved_contexts",
    f"""WITH r AS (SELECT h.question_id, rank, final_score, html AS text, url, regexp_extract(html, '{TITLE}', 1) AS title,
        CASE WHEN h.id % 3 = 0 THEN 'function' ELSE 'page' END AS kind, 500 + length(b.text) // 4 AS reserved
      FROM ({SQL_HYBRID}) h JOIN pages p ON p.page_id = h.id JOIN benchmark b ON b.item_id = h.question_id),
    d AS (SELECT *, length(text) // 4 AS tokens, len({SQL_LINES}) AS n FROM r WHERE text <> ''
      QUALIFY row_number() OVER (PARTITION BY question_id, left(text, 100) ORDER BY rank) = 1),
    u AS (SELECT *, reserved + sum(tokens) OVER (PARTITION BY question_id ORDER BY rank) AS used FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i FROM u WHERE used <= 6000),
    c AS (SELECT question_id, string_agg('### [' || i || '] ' || url || CASE WHEN title <> '' THEN ' → ' || title || ' (' || kind || ')' ELSE '' END
        || ' [Lines 1-' || n || ']' || chr(10) || '```html' || chr(10) || text || chr(10) || '```' || chr(10), chr(10) ORDER BY rank) AS parts,
        count(DISTINCT (url, title, kind, n, final_score)) AS n_sources FROM k GROUP BY question_id)
    SELECT item_id AS question_id, '## Relevant Code' || chr(10) || coalesce(chr(10) || parts, '') AS context, coalesce(n_sources, 0)::INT AS n_sources
    FROM benchmark LEFT JOIN c ON c.question_id = item_id""",
)
def retrieved_contexts(t):
    chunks, questions = kept_chunks(t), page_questions(t)
    ranked = (
        retrieve(chunks, questions, embedder=word_buckets).drop("repository_id")
        .join(chunks.drop("repository_id"), "id")
        .join(questions.select("question_id", "question"), "question_id")
    )
    packed = R.pack_context(ranked, "question_id", "rank", R.reserved_tokens(F.col("question")))
    texts = R.context_text(packed, "question_id", "rank")
    # a question whose first chunk already overflows keeps an empty context
    return questions.select("question_id").join(texts, "question_id", "left").select(
        "question_id", F.coalesce("context", F.lit(R.EMPTY_CONTEXT)).alias("context"),
        F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"),
    )


def ranked_documents(t):
    """Documents ranked by id inside their source; every third one occurs twice."""
    docs = t("documents").select(
        "doc_id", "source", F.col("text").alias("content"), F.concat(F.lit("src/doc"), F.col("doc_id").cast("string")).alias("file_path"),
        F.col("lang").alias("symbol_name"), F.lit("file_chunk").alias("symbol_type"), F.col("lang").alias("language"),
        F.lit(1).alias("start_line"), X.count_lines(F.col("text")).alias("end_line"), F.lit(0.5).alias("final_score"),
    )
    copies = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return docs.withColumn("_copy", F.explode(copies)).withColumn("position", F.col("doc_id") * 2 + F.col("_copy")).drop("_copy")


SQL_PACKED = f"""WITH r AS (SELECT doc_id, source, text AS content, lang, len({SQL_LINES}) AS n, doc_id * 2 + c AS position
      FROM documents, (SELECT unnest([0, 1]) AS c) WHERE c = 0 OR doc_id % 3 = 0),
    d AS (SELECT *, length(content) // 4 AS tokens FROM r WHERE content <> ''
      QUALIFY row_number() OVER (PARTITION BY source, left(content, 100) ORDER BY position) = 1),
    k AS (SELECT *, 500 + sum(tokens) OVER (PARTITION BY source ORDER BY position) AS used_tokens FROM d)
    SELECT source, position, doc_id, lang, n, content, tokens, used_tokens::BIGINT AS used_tokens FROM k WHERE used_tokens <= 6000"""


@query("context_pack", f"SELECT source, position, tokens, used_tokens FROM ({SQL_PACKED})")
def context_pack(t):
    packed = R.pack_context(ranked_documents(t), "source", "position", F.lit(V.RESERVED_TOKENS), width=512)
    return packed.select("source", "position", "tokens", "used_tokens")


@query(
    "context_text",
    f"""SELECT source, '## Relevant Code' || chr(10) || chr(10) || string_agg('### [' || i || '] src/doc' || doc_id || ' → ' || lang
      || ' (file_chunk) [Lines 1-' || n || ']' || chr(10) || '```' || lang || chr(10) || content || chr(10) || '```' || chr(10),
      chr(10) ORDER BY position) AS context, count(*)::INT AS n_sources
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS i FROM ({SQL_PACKED})) GROUP BY source""",
)
def context_text(t):
    packed = R.pack_context(ranked_documents(t), "source", "position", F.lit(V.RESERVED_TOKENS), width=512)
    return R.context_text(packed, "source", "position").select("source", "context", F.size("sources").alias("n_sources"))


def asked_conversations(t):
    """The last user turn of every conversation, and the turns before it."""
    turns = t("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    asked = first_per_group(turns.filter("role = 'user'"), "conv_id", F.desc("turn")).select(
        "conv_id", F.col("turn").alias("asked_turn"), F.col("content").alias("question")
    )
    before = turns.join(asked.select("conv_id", "asked_turn"), "conv_id").filter("turn < asked_turn")
    return asked, before.drop("asked_turn")


SQL_ASKED = """WITH a AS (SELECT conv_id, turn AS asked_turn, text AS question FROM conversations WHERE role = 'user'
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
    h AS (SELECT c.conv_id, c.turn, c.role, c.text AS content, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC)
      AS from_end FROM conversations c JOIN a ON a.conv_id = c.conv_id AND c.turn < a.asked_turn QUALIFY from_end <= 4)"""


@query("history_tail", f"{SQL_ASKED} SELECT conv_id, turn, role, from_end::INT AS from_end FROM h")
def history_tail(t):
    _, before = asked_conversations(t)
    return R.history_tail(before, "conv_id", F.desc("turn")).drop("content")


@query(
    "chat_messages",
    f"""{SQL_ASKED} SELECT a.conv_id, (count(h.turn) + 2)::INT AS n_messages, 'system: Answer from the context.' || chr(10) ||
      coalesce(string_agg(h.role || ': ' || h.content || chr(10), '' ORDER BY h.turn), '') || 'user: ' || any_value(a.question) AS body
    FROM a LEFT JOIN h ON a.conv_id = h.conv_id GROUP BY a.conv_id""",
)
def chat_messages(t):
    asked, before = asked_conversations(t)
    tail = R.history_tail(before, "conv_id", F.desc("turn"))
    sent = R.chat_messages(
        asked.withColumn("user_message", F.col("question")), tail, "conv_id", F.lit("Answer from the context.")
    )
    return sent.select(
        "conv_id", F.size("messages").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("body"),
    )


@query(
    "reserved_tokens",
    f"""{SQL_ASKED} SELECT a.conv_id, (500 + length(any_value(a.question)) // 4 + coalesce(sum(length(h.content) // 4), 0))::BIGINT AS reserved
    FROM a LEFT JOIN h ON a.conv_id = h.conv_id GROUP BY a.conv_id""",
)
def reserved_tokens(t):
    asked, before = asked_conversations(t)
    spent = R.history_tail(before, "conv_id", F.desc("turn")).groupBy("conv_id").agg(
        F.collect_list(F.struct("content")).alias("history")  # at most four messages
    )
    none = F.array().cast("array<struct<content:string>>")
    return asked.join(spent, "conv_id", "left").select(
        "conv_id", R.reserved_tokens(F.col("question"), F.coalesce("history", none)).alias("reserved")
    )
