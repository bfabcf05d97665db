"""The corpus pipeline: from documents to the token files that training reads.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

import public_tokenizers

from srcmill.llm import decontaminate, mixing, simhash, token_files, toxicity
from srcmill.llm.tables import stored
from srcmill.session import work_path


def rows_a_batch(spark, n):
    """Rows that go to Python at a time: few where they are whole documents, so that buffers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier, learned from the labels of these documents, doesn't reject."""
    rows_a_batch(spark, 500)
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark, docs, sf_dir):
    """One document, that of the smallest id, of each group linked by SimHash (3-word shingles, 3 bits of 64)."""
    rows_a_batch(spark, 4000)
    return simhash.first_of_each(docs)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents without a 10-word window of a benchmark item."""
    rows_a_batch(spark, 500)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def write_tokens(spark, docs, sf_dir):
    """The token files, written below the shared folder; what is returned is read back from them."""
    rows_a_batch(spark, 500)
    path = work_path(spark, "corpus-tokens")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path)


STAGES = [
    ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("benchmark_leaks", drop_benchmark_leaks), ("mixing", mix_sources), ("token_files", write_tokens),
]

#: The classifier and the fingerprints are not SQL; the tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
