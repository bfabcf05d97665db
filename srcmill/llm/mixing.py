"""Mixing sources to target weights.

Targets by capped water-filling; documents by a seeded order: every document is taken a whole number of times, and
those first in the order once more until the source's target is met.  DataFrame functions only.
"""

from pyspark.sql import Window, functions as F

from .tables import TOKEN, stored

#: Hexadecimal digits of the order key that form a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def words(text="text"):
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def order_key(seed, doc_id="doc_id", text="text"):
    """32 hexadecimal digits in which documents of a source are taken; rows of one id and text share a key."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}|"), part(doc_id), F.lit("|"), F.md5(part(text))))


def water_fill(sizes, share=1.5, epochs=2.0, weights=(3, 1, 2)):
    """Targets of sources(source, source_size): columns source, source_size, weight, target.

    Sources by code point, null last, take the weights in turn.  `share` times all sizes is dealt by weight; a source
    is clamped at `epochs` times its size and what it can't take is dealt to the others by weight.  Clamping raises
    the level of the rest, so in order of cap / weight the clamped sources are a prefix: source j is one of them if
    its cap is at most its part of what the sources before it leave.  No rows give no rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("turn", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("clamped", F.col("cap") <= F.col("weight") * F.col("left") / F.col("open"))
    )
    # the first source that isn't clamped holds the level of all that follow
    level = F.min(F.when(~F.col("clamped"), F.struct("turn_by_ratio", (F.col("left") / F.col("open")).alias("level")))).over(everything)["level"]
    return (
        ranked.withColumn("turn_by_ratio", F.row_number().over(by_ratio))
        .withColumn("level", level)
        .select("source", "source_size", "weight", F.when(F.col("clamped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))
    )


def schedule(narrow, share=1.5, epochs=2.0, weights=(3, 1, 2)):
    """What the mix takes of narrow(source, size, order_key).

    Returns (sources, edge): for each source its target, `whole` repetitions of every document and the bucket up to
    which documents are taken once more; and the keys taken once more inside that bucket.  One document per source
    is added or withdrawn if that brings the source nearer to its target.
    """
    bucket = F.substring("order_key", 1, BUCKET_DIGITS)
    cells = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("cell"))
    sources = (
        water_fill(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), share, epochs, weights)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        cells.withColumn("before", F.coalesce(F.sum("cell").over(before), F.lit(0)))
        .join(sources.select(F.col("source").alias("s"), "need"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("cell") >= F.col("need")))
        .groupBy("s").agg(F.min(F.struct("bucket", "before")).alias("cut"))
    )
    sources = (
        sources.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
        .select("source", "source_size", "weight", "target", "whole", "need", F.coalesce("cut.bucket", F.lit("")).alias("edge"), F.coalesce("cut.before", F.lit(0)).alias("edge_before"))
    )
    named = sources.select(F.col("source").alias("s"), "need", "edge", "edge_before")
    running = Window.partitionBy("source").orderBy("order_key").rangeBetween(Window.unboundedPreceding, 0)
    edge = (
        narrow.join(named, F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("edge")))
        .withColumn("reached", F.col("edge_before") + F.sum("size").over(running))
        .filter(F.col("reached") - F.col("size") / 2 < F.col("need"))
        .groupBy("source", F.col("order_key").alias("edge_key")).agg(F.sum("size").alias("edge_size"))
    )
    taken = edge.groupBy(F.col("source").alias("t")).agg(F.sum("edge_size").alias("inside"))
    rest = (
        named.join(taken, F.col("s").eqNullSafe(F.col("t")), "left")
        .select("s", "edge", (F.col("need") - F.col("edge_before") - F.coalesce("inside", F.lit(0))).alias("rest"))
    )
    keyed = edge.select("edge_key", F.col("source").alias("e"))
    once_more = (bucket < F.col("edge")) | F.col("edge_key").isNotNull()
    off = F.abs(F.abs("rest") - F.col("together"))
    # a hot source is dealt by the last digit of the key, too
    salted = rest.withColumn("digit", F.explode(F.array(*(F.lit(f"{d:x}") for d in range(16)))))
    nearer = (
        narrow.groupBy("source", "order_key").agg(F.sum("size").alias("together"))
        .withColumn("salt", F.substring("order_key", -1, 1))
        .join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("digit")))
        .join(keyed, (F.col("order_key") == F.col("edge_key")) & F.col("source").eqNullSafe(F.col("e")), "left")
        .filter((off < F.abs("rest")) & (once_more == (F.col("rest") < 0)))
        .groupBy("s", "salt").agg(F.min(F.struct(off.alias("off"), "order_key")).alias("best"))
        .groupBy("s").agg(F.min("best")["order_key"].alias("turned"))
    )
    sources = sources.join(nearer, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return sources, edge.select("source", "edge_key")


def narrow_rows(docs, seed="mix"):
    """doc_id, source, size and order key of the documents."""
    return docs.select("doc_id", "source", words().alias("size"), order_key(seed).alias("order_key"))


def draw(rows, share=1.5, epochs=2.0, weights=(3, 1, 2)):
    """rows(source, size, order_key, ...) with `source_size`, `target` and `repeats`: times that the mix takes the row.

    A null text has no words; documents without words are taken as often as the others but add nothing.  Repeated
    rows of an id and text are taken alike.  Rerunning gives the same rows: the order depends on seed, id and text.
    Hot sources: sums are pre-aggregated over 4,096 buckets of the order; only the bucket in which the target is
    reached is ordered row by row.
    """
    return _drawn(rows, *schedule(rows.select("source", "size", "order_key"), share, epochs, weights))


def _drawn(rows, sources, edge):
    sources = sources.select(F.col("source").alias("s"), "source_size", "target", "whole", "edge", "turned")
    edge = edge.select(F.col("source").alias("e"), "edge_key")
    once_more = (F.substring("order_key", 1, BUCKET_DIGITS) < F.col("edge")) | F.col("edge_key").isNotNull()
    turned = F.coalesce(F.col("turned") == F.col("order_key"), F.lit(False))
    return (
        rows.join(sources, F.col("source").eqNullSafe(F.col("s")))
        .join(edge, (F.col("order_key") == F.col("edge_key")) & F.col("source").eqNullSafe(F.col("e")), "left")
        .withColumn("repeats", F.col("whole") + (once_more != turned).cast("long"))
        .drop("s", "e", "whole", "edge", "edge_key", "turned")
    )


def mixed(docs, seed="mix", share=1.5, epochs=2.0, weights=(3, 1, 2)):
    """The documents, each as many times as the mix takes it, with the columns of `docs`.

    The mix is decided on sizes and keys, written once; the texts meet its two small tables in one pass.
    """
    narrow = stored(narrow_rows(docs, seed).select("source", "size", "order_key"), "mix-sizes")
    sources, edge = schedule(narrow, share, epochs, weights)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, "source", order_key(seed).alias("order_key"))
    return (
        _drawn(rows, stored(sources, "mix-sources"), stored(edge, "mix-edge"))
        .select("row", F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int"))))
        .select("row.*")
    )
