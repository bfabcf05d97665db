"""Hybrid retrieval for many questions at once: keyword candidates, reranking, context packing."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..functions.rows import each
from ..session import cut_lineage
from .inventory import substring_pairs
from .running import first_per_group, running_total


EMPTY_CONTEXT = "## Relevant Code\n"
#: Length of the character grams of content postings.
GRAM_CHARS = 4


def question_terms(questions, question="question"):
    """Add the ranking terms and the candidate terms of each question."""
    return questions.withColumns(
        {"terms": X.search_words(F.col(question)), "keywords": X.keyword_words(F.col(question))}
    )


def keyword_candidates(chunks, questions, scope="repository_id"):
    """(scope, question_id, id): chunks whose symbol name or path contains a keyword of the question.

    Only names are read here; content is joined back later.  Equal keywords of several questions are matched once.
    """
    asked = each(questions, "keywords", "term", [scope, "question_id"])
    # words never contain the separator, so one text covers both names
    names = chunks.select(
        scope, "id",
        F.lower(F.concat_ws("\x01", F.coalesce("symbol_name", F.lit("")), F.coalesce("file_path", F.lit("")))).alias("names"),
    )
    hits = substring_pairs(asked.select(scope, "term").distinct(), "term", names, "names", [scope], grams=(4,))
    return hits.select(scope, "term", "id").join(asked, [scope, "term"]).select(scope, "question_id", "id").distinct()


def exclude_retrieved(candidates, vector_hits):
    """Keyword candidates that the vector search has not returned already."""
    return candidates.join(vector_hits.select("question_id", "id"), ["question_id", "id"], "left_anti")


def hybrid_candidates(vector_hits, candidates, scope="repository_id"):
    """Vector hits with their score and rank, then the remaining keyword candidates with the fixed score."""
    words = exclude_retrieved(candidates, vector_hits).select(
        scope, "question_id", "id", F.lit(V.KEYWORD_SCORE).alias("score"), F.lit(None).cast("int").alias("vector_rank")
    )
    return vector_hits.select(
        scope, "question_id", "id", "score", F.col("rank").cast("int").alias("vector_rank")
    ).unionByName(words)


def name_score(base, terms, symbol, path, kind):
    """Base score plus the bonuses that need no content."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return (
        base
        + X.count_contained(terms, blank(symbol)) * V.SYMBOL_BONUS
        + X.count_contained(terms, blank(path)) * V.PATH_BONUS
        + F.when(kind.isin("function", "method", "class"), V.TYPE_BONUS).otherwise(0.0)
    )


def with_content(name, n_terms):
    """The final score; it is rounded so that ties are exact."""
    return F.round(name + n_terms * V.CONTENT_BONUS, 9)


def _named(candidates, chunks, questions):
    """Candidates with the terms of their question and what their names score; contents stay where they are."""
    names = chunks.select("id", "symbol_name", "file_path", "symbol_type")
    score = name_score(F.col("score"), F.col("terms"), F.col("symbol_name"), F.col("file_path"), F.col("symbol_type"))
    return candidates.join(questions.select("question_id", "terms"), "question_id").join(names, "id").withColumn("_name", score).drop(*names.columns[1:])


def content_hits(candidates, chunks):
    """(id, hits): of all terms that any question asks of a chunk, those that its content holds.

    A content is read and lower-cased once and every distinct term looked up once in it, however many questions ask.
    """
    asked = each(candidates, "terms", "_term", ["id"]).distinct().groupBy("id").agg(F.collect_list("_term").alias("_asked"))
    held = X.bind(F.lower(F.coalesce("content", F.lit(""))), lambda text: F.filter("_asked", lambda w: text.contains(w)))
    return chunks.select("id", "content").join(asked, "id").select("id", held.alias("hits"))


def _scored(named, chunks, scope):
    score = with_content(F.col("_name"), F.size(F.array_intersect("terms", "hits")))
    return named.join(content_hits(named, chunks), "id").select(scope, "question_id", "id", "vector_rank", score.alias("final_score"))


def rerank(candidates, chunks, questions, k=V.CONTEXT_HITS, scope="repository_id"):
    """The best k chunks per question, of candidates that are few: all of them are scored."""
    return best_of(_scored(_named(candidates, chunks, questions), chunks, scope), k)


def content_postings(chunks, n=GRAM_CHARS):
    """(gram, id): the hashed grams of n word characters of every content; an index to write once and keep."""
    grams = F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(rf"(?U)(?=(\w{{{n}}}))"), F.lit(1))
    return each(chunks.select("id", F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))).alias("_grams")), "_grams", "gram", ["id"]).select("gram", "id")


def _possible_terms(questions, postings, n):
    """(id, possible): terms whose rarest gram occurs in a chunk; terms shorter than a gram are in none of these."""
    terms = each(questions, "terms", "_term", []).distinct().filter(F.length("_term") >= n)
    grams = F.transform(F.regexp_extract_all(F.col("_term"), F.lit(rf"(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.xxhash64(g))
    needles = each(terms, F.array_distinct(grams), "gram", ["_term"])
    lists = cut_lineage(postings.join(needles.select("gram").distinct(), "gram", "left_semi"))
    sizes = lists.groupBy("gram").agg(F.count("*").alias("_n"))
    # a term one of whose grams occurs nowhere occurs nowhere
    rarest = needles.join(sizes, "gram", "left").groupBy("_term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    return lists.join(rarest.select("_term", F.col("r.gram").alias("gram")), "gram").groupBy("id").agg(F.collect_list("_term").alias("possible"))


def rank_keyword_candidates(chunks, questions, k, scope="repository_id", postings=None, n=GRAM_CHARS):
    """The best k keyword candidates per question: (scope, question_id, id, final_score, rank).

    Names decide in a gram join which chunks are candidates, and their bonuses are known before any content is read.
    The terms that a content may hold, those whose rarest gram it has, bound its bonus.  `postings` are the grams of all
    contents, kept from before; without them the candidates' contents are cut into grams here, once each.  The k
    candidates of highest bound are scored first; then only those whose bound reaches the k-th of these scores are
    read, so what is left unread can't be among the best k.
    """
    found = cut_lineage(keyword_candidates(chunks, questions, scope))
    named = _named(found.withColumns({"score": F.lit(V.KEYWORD_SCORE), "vector_rank": F.lit(None).cast("int")}), chunks, questions)
    if postings is None:
        postings = content_postings(chunks.join(found.select("id").distinct(), "id", "left_semi"), n)
    short = F.size(F.filter("terms", lambda w: F.length(w) < n))
    none = F.array().cast("array<string>")
    open_terms = F.size(F.array_intersect("terms", F.coalesce("possible", none))) + short
    named = named.join(_possible_terms(questions, postings, n), "id", "left")
    bounded = cut_lineage(named.withColumn("_bound", with_content(F.col("_name"), open_terms)).drop("possible", "score"))
    ahead = first_per_group(bounded, "question_id", F.desc("_bound"), F.col("id"), n=k, rank="_turn")
    first = cut_lineage(_scored(ahead, chunks, scope))
    safe = first.groupBy("question_id").agg(F.count("*").alias("_n"), F.min("final_score").alias("_kth")).filter(F.col("_n") >= k)
    rest = bounded.join(ahead.select("question_id", "id"), ["question_id", "id"], "left_anti").join(safe.select("question_id", "_kth"), "question_id")
    # a question with fewer than k candidates has no rest
    second = _scored(rest.filter("_bound >= _kth"), chunks, scope)
    return best_of(first.unionByName(second), k).drop("vector_rank")


def best_of(scored, k):
    """Final order: score, then vector hits in their order, then id."""
    return first_per_group(
        scored, "question_id", F.desc("final_score"), F.asc_nulls_last("vector_rank"), F.col("id"), n=k, rank="rank"
    )


def reserved_tokens(question, history=None, summary=None):
    """Tokens spent before any chunk is packed."""
    spent = F.lit(V.RESERVED_TOKENS) + X.estimate_tokens(question)
    if summary is not None:
        spent = spent + X.estimate_tokens(F.coalesce(summary, F.lit("")))
    if history is not None:
        spent = spent + F.aggregate(history, F.lit(0).cast("long"), lambda n, m: n + X.estimate_tokens(m["content"]))
    return spent


def pack_context(ranked, key, order, reserved, budget=V.CONTEXT_TOKENS, width=4096):
    """Chunks that fit the token budget per `key`, in the order of the integral, unique `order`.

    Empty chunks and repeated openings (first 100 characters) are left out first.  Token sums never fall, so
    "stop at the first overflow" is the same as keeping the rows whose running sum stays within the budget.
    """
    opening = F.substring("content", 1, V.DUPLICATE_KEY_CHARS)
    filled = ranked.filter(F.coalesce(F.length("content"), F.lit(0)) > 0).select(
        key, order, opening.alias("_opening"), X.estimate_tokens(F.col("content")).alias("tokens"),
        reserved.cast("long").alias("_reserved"),
    )
    # the content itself stays out of the window shuffles; survivors are few and fetch it back below
    fresh = first_per_group(filled, [key, "_opening"], order).drop("_opening")
    packed = running_total(fresh, key, order, "tokens", "used_tokens", width=width, limit=budget)
    packed = packed.withColumn("used_tokens", F.col("used_tokens") + F.col("_reserved")).filter(
        F.col("used_tokens") <= budget
    )
    return packed.drop("_reserved").join(ranked, [key, order])


def source_struct():
    return F.struct("file_path", "symbol_name", "symbol_type", "start_line", "end_line", F.col("final_score").alias("score"))


def context_text(packed, key, order):
    """One context text and the distinct sources per `key`; the packed rows per key are bounded by the budget."""
    name = F.coalesce("symbol_name", F.lit(""))
    numbered = packed.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order)))
    block = F.concat(
        F.lit("### ["), F.col("_n").cast("string"), F.lit("] "), F.col("file_path"),
        F.when(name != "", F.concat(F.lit(" → "), name, F.lit(" ("), F.coalesce("symbol_type", F.lit("")), F.lit(")")))
        .otherwise(""),
        F.lit(" [Lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"),
        F.lit("]\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("content"), F.lit("\n```\n"),
    )
    parts = F.sort_array(F.collect_list(F.struct("_n", block.alias("b"), source_struct().alias("s"))))
    return numbered.groupBy(key).agg(parts.alias("_p")).select(
        key,
        F.concat(F.lit(EMPTY_CONTEXT + "\n"), F.array_join(F.transform("_p", lambda p: p["b"]), "\n")).alias("context"),
        F.array_distinct(F.transform("_p", lambda p: p["s"])).alias("sources"),
    )


def with_repository_overview(context, summary):
    """Put the repository summary, where there is one, in front of a context text."""
    return F.when(
        F.coalesce(summary, F.lit("")) != "",
        F.concat(F.lit("## Repository Overview\n"), summary, F.lit("\n\n"), context),
    ).otherwise(context)


def history_tail(messages, key, *newest_first, n=V.HISTORY_MESSAGES):
    """The last n messages per conversation with their position from the end (1 = newest)."""
    return first_per_group(messages, key, *newest_first, n=n, rank="from_end")


def in_message_order(messages):
    return messages.orderBy("created_at", F.desc("role"), "id")


def chat_messages(questions, tail, key, system):
    """system + last messages + user, as one array per question; `tail` comes from history_tail."""
    history = tail.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.negative("from_end").alias("o"), "role", "content"))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("_history")
    )
    message = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return questions.join(history, key, "left").select(
        key,
        F.concat(message("system", system), F.coalesce("_history", none), message("user", F.col("user_message"))).alias(
            "messages"
        ),
    )
