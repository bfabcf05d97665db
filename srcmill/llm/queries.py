"""The registered queries of the operators, with SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe_stream, decontaminate, license_scan, main_text, mixing, repeats, simhash, spelling, token_files, topk, toxicity, turn_trie, url_rules
from ..session import work_path
from .oracles import SQL  # noqa: F401
from .tables import stored

QUERIES = {}


def query(function):
    def run(spark, sf_dir):
        return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[function.__name__] = run
    return function


@query
def op1_license_scan(table):
    docs = license_scan.scan(table("documents").select("doc_id", "text"))
    top = F.array_min(F.transform("licences", lambda m: F.struct((-m["score"]).alias("minus"), m["licence"].alias("licence"), m["part"])))
    return docs.select(
        "doc_id", F.size("licences").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("licences.licence")), ",").alias("licences"),
        top["licence"].alias("licence"), F.round(-top["minus"], 9).alias("score"),
    )


@query
def op2_url_filter(table):
    pages = table("pages").select("page_id", "url")
    mined = stored(url_rules.mine_rules(url_rules.labelled_pages(pages, table("labels"))), "mined")
    return url_rules.judge(pages, mined).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


@query
def op8_mixing(table):
    rows = stored(mixing.narrow_rows(table("documents")), "mix-sizes")
    return mixing.draw(rows).select(
        "doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken")
    )


@query
def op3_decontamination(table):
    index = decontaminate.build_index(table("documents"))
    found = decontaminate.search(index, table("benchmark"))
    return decontaminate.judged(index, found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )


@query
def op4_simhash(table):
    return simhash.near_duplicates(table("documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op5_topk(table):
    rows = topk.whole_numbers(table("embeddings"))
    asked = topk.whole_numbers(table("embeddings").filter("vec_id % 50 = 0"))
    return topk.search(topk.build_index(rows), asked, 5)


@query
def op6_token_files(table):
    docs = table("documents")
    path = work_path(docs.sparkSession, "token-files")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(docs.sparkSession, path)


@query
def op7_toxicity(table):
    docs = table("documents").select("doc_id", "text")
    model = toxicity.fit(docs, table("labels").filter(~toxicity.held_out()))
    scored = docs.select("doc_id", toxicity.held_out().alias("held_out"), toxicity.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op9_main_text(table):
    pages = table("pages").select("page_id", "url", main_text.extract().alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query
def op10_repeats(table):
    return repeats.repeats(table("documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_spelling_variants(table):
    words = spelling.word_counts(table("documents"), least_length=7, least_count=2, change=spelling.dropped_letter)
    return spelling.variants(stored(words, "words"), times=10)


@query
def op12_bpe_stream(table):
    return bpe_stream.digests(table("documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_conversation_trie(table):
    return turn_trie.conversation_trie(table("conversations"))
