"""Connected components of a graph given as edges, by alternating large and small stars."""

from pyspark.sql import functions as F

from .tables import stored


def _stars(edges, large):
    """Large: every node hangs its larger neighbours on its smallest one; small: its smaller ones and itself."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(flipped)
    around = around if large else around.filter("v < u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("least"))
    hung = around.join(least, "u")
    if large:
        hung = hung.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        hung = hung.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
    return hung.filter("u <> v").distinct()


def components(edges):
    """edges(u, v) of long -> (node, root) for every node of an edge; the root is the smallest node reachable.

    Self-loops and repeated edges change nothing; no edges give no rows.  Rounds grow with the logarithm of the
    longest chain.  Every round is written to the shared folder, so lost executors cost one round.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        edges = stored(_stars(_stars(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
