"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every text is lower-cased and cut into byte n-grams of three lengths.  Labelled texts give each n-gram the log ratio of
its shares of toxic and clean texts; the most telling n-grams, scaled by that ratio, are the features of a logistic
regression.  Hash buckets find the candidates, as a first count and as a filter; n-grams themselves are exact.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from .tables import WORD_BYTES, free_name, stored, trimmed

LENGTHS = (3, 4, 5)
BUCKET_BITS = 20
#: Texts are hashed in pieces of so many bytes, to bound memory.
CHUNK = 1 << 20
#: So many n-grams of texts are held before they are counted together.
FLUSH = 1 << 22


class Model(NamedTuple):
    bias: float
    grams: list
    weights: list


def normal(text):
    """Lower case; words of letters, digits and other scripts, with one space around each."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(WORD_BYTES).split()) + b" "


def gram_buckets(data):
    """Per n-gram length, the bucket of the n-gram at each byte."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = np.full(len(a), 7, np.uint32)
    for n in range(1, LENGTHS[-1] + 1):
        if len(a) < n:
            return
        h = h[: len(a) - n + 1] * np.uint32(0x01000193) + a[n - 1 :]
        if n in LENGTHS:
            yield (h * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def _pieces(data):
    for start in range(0, max(1, len(data)), CHUNK):
        yield data[start : start + CHUNK + LENGTHS[-1] - 1]


def found_buckets(data):
    """Distinct buckets of a text."""
    kept = [np.unique(buckets) for piece in _pieces(data) for buckets in gram_buckets(piece)]
    return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.uint32)


def found_grams(data, wanted):
    """Distinct n-grams of a text in the buckets that `wanted`, a mask, holds: their bytes and length as one number."""
    kept = []
    for piece in _pieces(data):
        a = np.frombuffer(piece, np.uint8).astype(np.int64)
        for n, buckets in zip(LENGTHS, gram_buckets(piece)):
            at = np.flatnonzero(wanted[buckets])
            kept.append(np.unique(sum((a[at + j] << (8 * j) for j in range(n)), np.int64(n) << 40)))
    return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)


def bucket_of(gram):
    n = int(gram) >> 40
    data = (int(gram) & ((1 << 40) - 1)).to_bytes(5, "little")[:n]
    return int(list(gram_buckets(data))[LENGTHS.index(n)][0])


def mask_of(grams):
    wanted = np.zeros(1 << BUCKET_BITS, bool)
    wanted[[bucket_of(g) for g in grams]] = True
    return wanted


def _count_buckets(batches):
    """Partial sums of texts by bucket and label; one row per bucket and task."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for frame in batches:
        for text, toxic in zip(frame["text"], frame["toxic"]):
            counts[toxic, found_buckets(normal(text))] += 1
    some = np.flatnonzero(counts.sum(axis=0))
    for i in range(0, len(some), 100_000):
        part = some[i : i + 100_000]
        yield pd.DataFrame({"gram": part, "toxic_texts": counts[1, part], "clean_texts": counts[0, part]})


def _count_grams(buckets):
    """The same by n-gram, for those in the given buckets; several rows an n-gram and task."""
    empty = np.empty(0, np.int64)

    def count(batches):
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[buckets] = True

        def counted(held):
            (toxic, p), (clean, q) = (np.unique(np.concatenate([empty, *held[label]]), return_counts=True) for label in (1, 0))
            grams = np.union1d(toxic, clean)
            counts = np.zeros((2, len(grams)), np.int64)
            counts[1, np.searchsorted(grams, toxic)], counts[0, np.searchsorted(grams, clean)] = p, q
            for i in range(0, len(grams), 100_000):
                part = slice(i, i + 100_000)
                yield pd.DataFrame({"gram": grams[part], "toxic_texts": counts[1, part], "clean_texts": counts[0, part]})

        held, size = ([], []), 0
        for frame in batches:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                grams = found_grams(normal(text), wanted)
                held[toxic].append(grams)
                size += len(grams)
                if size >= FLUSH:
                    yield from counted(held)
                    held, size = ([], []), 0
        yield from counted(held)

    return count


def counted_texts(rows, count, label):
    """Texts by label with each n-gram (or bucket), by one of the counts above: (gram, p, q)."""
    counts = rows.mapInPandas(trimmed(count), "gram long, toxic_texts long, clean_texts long").groupBy("gram").agg(F.sum("toxic_texts").alias("p"), F.sum("clean_texts").alias("q"))
    return stored(counts, label)


def surprise(p, q, n_toxic, n_clean):
    """The log-likelihood ratio statistic (G) of the two-by-two table of texts by label and n-gram."""
    toxic, clean = F.lit(float(n_toxic)), F.lit(float(n_clean))
    part = lambda n, of, given: F.when(n > 0, n * F.log(n * (toxic + clean) / (of * given))).otherwise(0.0)
    inside, outside = p + q, toxic + clean - p - q
    return 2 * (part(p, toxic, inside) + part(q, clean, inside) + part(toxic - p, toxic, outside) + part(clean - q, clean, outside))


def telling(two, least_surprise, chance, most, smoothing):
    """The n-grams that are most unevenly spread over the labels: (gram, surprise, ratio), most telling first.

    They are as many as a share of `chance` of them can be expected to be uneven by chance (Benjamini and Hochberg),
    given how many n-grams are in enough texts to reach `least_surprise` at all.

    Ratio is the logarithm of the n-gram's share of toxic texts' n-grams over its share of clean ones'.  Buckets only
    spare the counting of n-grams that can't reach the bar: none is in more texts than its bucket, and G is convex, so
    it is at most the largest G at the corners of what the bucket's counts allow.
    """
    texts = {r["toxic"]: r["count"] for r in two.groupBy("toxic").count().collect()}
    n = (texts.get(1, 0), texts.get(0, 0))
    p, q, zero = F.col("p").cast("double"), F.col("q").cast("double"), F.lit(0.0)
    bound = F.greatest(surprise(p, zero, *n), surprise(zero, q, *n), surprise(p, q, *n))
    # at most 2 ** BUCKET_BITS numbers
    buckets = [r["gram"] for r in counted_texts(two, _count_buckets, "toxic-buckets").filter(bound >= least_surprise - 1e-6).select("gram").collect()]
    if not buckets:
        return []
    counts = counted_texts(two, _count_grams(np.array(buckets)), "toxic-counts")
    total = counts.agg(F.count("*").alias("n"), F.sum(F.col("p") + smoothing).alias("p"), F.sum(F.col("q") + smoothing).alias("q")).first()
    if total["p"] is None:
        return []
    ratio = F.log((F.col("p") + smoothing) / F.lit(total["p"])) - F.log((F.col("q") + smoothing) / F.lit(total["q"]))
    best = (
        counts.withColumn("surprise", surprise(p, q, *n)).filter(F.col("surprise") >= least_surprise)
        .orderBy(F.desc("surprise"), "gram").limit(most).select("gram", "surprise", ratio.alias("ratio")).collect()
    )
    by_chance = lambda g: total["n"] * math.erfc(math.sqrt(g / 2))
    return best[: max((k for k, r in enumerate(best, 1) if by_chance(r["surprise"]) <= chance * k), default=0)]


def training_rows(docs, labels, rows_a_class=10_000):
    """The labelled texts to learn from: (text, toxic, weight), at most `rows_a_class` labels of either class.

    Labels of a document that disagree count as toxic.  Rows are chosen by the hash of doc_id.  Weights restore the
    classes' shares among all labels.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    classes = [
        known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_a_class)
        .withColumn("weight", F.lit(n / min(n, rows_a_class)))
        for toxic, n in sorted(totals.items())
    ]
    if len(classes) < 2:
        return None, totals
    chosen = classes[0].unionByName(classes[1])
    # at most 2 x rows_a_class rows of three numbers: a proven bound for the broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "weight"), totals


def fit(docs, labels, rows_a_class=10_000, features=4096, least_surprise=10.0, chance=0.01, smoothing=1.0, regularisation=1e-3):
    """Learn from docs(doc_id, text) and labels(doc_id, toxic).

    `rows_a_class` bounds the sample that is learned from, `features` the n-grams that the model holds.  An n-gram is
    held if its texts' labels are too uneven for chance: its surprise is at least `least_surprise` and at most a share
    of `chance` of the n-grams held can be expected to be uneven by chance (see `telling`).  How loud others are doesn't
    matter, so rarer kinds of toxicity are learned beside common ones; labels that say nothing about the text are not
    learned by heart.  Copies of
    a text are learned from once, as toxic if any of them is.  Without labels of both classes, or such n-grams, the model is the share of toxic
    labels.
    """
    rows, totals = training_rows(docs, labels, rows_a_class)
    prior = float(np.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5)))
    if rows is None:
        return Model(prior, [], [])
    # within the bound of the sample
    rows = stored(rows.groupBy("text").agg(F.max(F.struct("toxic", "weight")).alias("label")).select("text", "label.*"), "toxic-training")
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    two = spread.select("text", "toxic")
    best = telling(two, least_surprise, chance, features, smoothing)
    if not best:
        return Model(prior, [], [])
    chosen = [r["gram"] for r in best]

    def present(batches):
        wanted, known = mask_of(chosen), np.array(sorted(chosen))
        for frame in batches:
            frame["terms"] = [np.intersect1d(found_grams(normal(t), wanted), known).astype(str) for t in frame.pop("text")]
            yield frame

    terms = stored(spread.select("text", "toxic", "weight").mapInPandas(trimmed(present), "toxic int, weight double, terms array<string>"), "toxic-terms")
    vectors = CountVectorizerModel.from_vocabulary([str(g) for g in chosen], "terms", "present")
    vectors.setBinary(True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([r["ratio"] for r in best]), inputCol="present", outputCol="features")
    # the ratios scale the features, so they aren't standardised again
    learner = LogisticRegression(labelCol="toxic", weightCol="weight", regParam=regularisation, standardization=False, maxIter=100)
    fitted = learner.fit(scaled.transform(vectors.transform(terms)))
    return Model(float(fitted.intercept), chosen, [float(w * r["ratio"]) for w, r in zip(fitted.coefficients, best)])


def score(model, text="text"):
    """Column: probability that the text is toxic, to six digits; an empty or null text gets the model's bias alone."""

    @F.pandas_udf("double")
    @trimmed
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wanted = mask_of(model.grams)
        order = np.argsort(np.array(model.grams, np.int64))
        known, weights = np.array(model.grams, np.int64)[order], np.append(np.array(model.weights)[order], 0.0)

        def total(text):
            grams = found_grams(normal(text), wanted)
            at = np.searchsorted(known, grams)
            return weights[np.where(np.append(known, -1)[at] == grams, at, len(known))].sum()

        for texts in batches:
            sums = np.array([total(t) for t in texts], float)
            yield pd.Series(np.round(1 / (1 + np.exp(-np.clip(sums + model.bias, -500, 500))), 6))

    return scored(F.col(text))


def held_out(doc_id="doc_id"):
    """Whether a label is kept from learning: crc32 of the id's text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def clean_documents(docs, labels, threshold=0.5):
    """The documents that the classifier, learned from the labels that aren't held out, doesn't reject."""
    model = fit(docs, labels.filter(~held_out()))
    name = free_name(docs, "toxic_score")
    return docs.withColumn(name, score(model)).filter(F.col(name) < threshold).drop(name)
