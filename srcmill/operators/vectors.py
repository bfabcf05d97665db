"""Embedding of chunk texts and exact nearest-vector search."""

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import fixed_values as V
from ..functions import text as X
from ..session import cut_lineage
from .running import first_per_group

DIMENSIONS = 384
#: Vectors of a partition or tile, pivots of a scope, vectors and queries that meet in one task.
PARTITION_ROWS, MAX_PIVOTS, BLOCK_ROWS, QUERY_BLOCK = 4096, 512, 20_000, 4096


def embedding_text(path, symbol, kind, content):
    """The text a chunk is embedded as."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit("File: "), path, F.lit("\nSymbol: "), blank(symbol), F.lit(" ("), blank(kind), F.lit(")\n\n"), content
    )


def embed(df, text, dimensions=DIMENSIONS, embedder=None, out="embedding", max_chars=None):
    """Add unit vectors.  The default hashes words; `embedder` may be any Arrow/pandas UDF text -> array<float>.

    Whole texts are embedded; `max_chars` is for a model whose input is bounded (V.EMBED_CHARS is a common bound).
    """
    clipped = df.withColumn("_clipped", F.col(text) if max_chars is None else X.clip(F.col(text), max_chars))
    if embedder is not None:
        return clipped.withColumn(out, embedder(F.col("_clipped"))).drop("_clipped")
    tokens = clipped.withColumn("_tokens", F.regexp_extract_all(F.lower("_clipped"), F.lit(r"(?U)\w+"), F.lit(0)))
    counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions).transform(tokens)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_clipped", "_tokens", "_tf", "_unit")


def cosine(a, b):
    """Dot product of unit vectors, in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p
    )


def vector_search(vectors, query, n, id_col="id", where=None):
    """Top n by cosine for one query vector (a list of numbers), as a distributed top-k.

    n is bounded by the size of the collection, which is counted before the filter is applied; a top-k never
    returns more rows than exist, so that bound holds by itself.
    """
    kept = vectors if where is None else vectors.filter(where)
    literal = F.array(*[F.lit(float(x)) for x in query])
    # a rounded sort key makes copies of a vector tie exactly
    return (
        kept.withColumn("_cos", F.round(cosine(F.col("embedding"), literal), 12))
        .orderBy(F.desc("_cos"), id_col)
        .limit(n)
        .withColumn("score", F.round("_cos", 4))
        .drop("_cos", "embedding")
    )


def vector_search_many(vectors, queries, k, id_col="id", query_col="query_id", scope=None, rows=PARTITION_ROWS, max_pivots=MAX_PIVOTS, query_block=QUERY_BLOCK):
    """Top k vectors by dot product for every query vector: (query_col, id_col, score, rank); ties go to the lower id.

    Both sides are tables; nothing but counts reaches the driver.  Vectors are partitioned around pivots (see
    `partitioned`), and a partition with centre c and radius r holds no vector that scores more than q.c + |q|r.  A
    first round searches the partitions of highest bound until they hold k vectors, which gives a k-th score; a second
    one visits only partitions whose bound reaches it.  With `scope`, a query only meets vectors of equal scope.
    Vectors and queries that are null take no part.
    """
    members, centres = partitioned(vectors, id_col, scope, rows, max_pivots)
    asked = _with_scope(queries, query_col, scope)
    blocks = asked.groupBy("_scope").agg(F.ceil(F.count("*") / query_block).alias("_blocks"))
    asked = cut_lineage(asked.join(blocks, "_scope").withColumn("_block", F.pmod(F.xxhash64("_id"), "_blocks")).drop("_blocks"))
    bounds = cut_lineage(_bounds(asked, centres, blocks))
    before = W.partitionBy("_query").orderBy(F.desc("_bound"), "_pivot").rowsBetween(W.unboundedPreceding, -1)
    turns = bounds.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    first = cut_lineage(_visit(turns.filter(F.col("_before") < k), asked, members, k))
    kth = first.groupBy("_query").agg(F.count("*").alias("_found"), F.sort_array(F.collect_list("_cos"), asc=False).alias("_scores"))
    kth = kth.select("_query", F.when(F.col("_found") >= k, F.element_at("_scores", k)).alias("_kth"))
    later = turns.filter(F.col("_before") >= k).join(kth, "_query").filter(F.col("_kth").isNull() | (F.col("_bound") >= F.col("_kth")))
    second = _visit(later, asked, members, k)
    best = first_per_group(first.unionByName(second), "_query", F.desc("_cos"), F.col("_id"), n=k, rank="rank")
    return best.select(
        F.col("_query").alias(query_col), F.col("_id").alias(id_col), "rank", F.round("_cos", 4).alias("score"),
    )


def _with_scope(df, id_col, scope):
    """(_scope, _id, embedding); without a scope all rows share one."""
    key = F.lit("") if scope is None else F.col(scope).cast("string")
    return df.select(key.alias("_scope"), F.col(id_col).alias("_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null and _scope is not null")


def partitioned(vectors, id_col="id", scope=None, rows=PARTITION_ROWS, max_pivots=MAX_PIVOTS):
    """Vectors around pivots: members (_scope, _pivot, _tile, _id, embedding) and centres (_scope, _pivot, c, _n, _radius).

    Pivots are vectors taken by the hash of their id, one for `rows` vectors of a scope and at most `max_pivots`; every
    vector belongs to the nearest.  Partitions beyond `rows` rows are cut into tiles.
    """
    slim = _with_scope(vectors, id_col, scope)
    sizes = slim.groupBy("_scope").agg(F.count("*").alias("_n"))
    sizes = cut_lineage(sizes.select("_scope", F.least(F.ceil(F.col("_n") / rows), F.lit(max_pivots)).alias("_pivots"), F.ceil(F.col("_n") / BLOCK_ROWS).alias("_blocks")))
    drawn = first_per_group(slim, "_scope", F.xxhash64("_id"), F.col("_id"), n=max_pivots, rank="_pivot")
    pivots = cut_lineage(drawn.join(sizes, "_scope").filter("_pivot <= _pivots").select("_scope", "_pivot", "_blocks", "embedding"))
    left = slim.join(sizes, "_scope").withColumn("_block", F.pmod(F.xxhash64("_id"), "_blocks")).drop("_pivots", "_blocks")
    right = pivots.select("_scope", "_pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"), "embedding")
    kind = dict(slim.dtypes)["_id"]
    near = _cogrouped(left, right, ["_scope", "_block"], _nearest, f"_scope string, _pivot int, _id {kind}, embedding array<double>, _distance double")
    near = cut_lineage(near)
    stats = near.groupBy("_scope", "_pivot").agg(F.count("*").alias("_n"), F.max("_distance").alias("_radius"))
    centres = cut_lineage(stats.join(pivots.drop("_blocks"), ["_scope", "_pivot"]))
    tile = F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / rows))
    return near.join(centres.select("_scope", "_pivot", "_n"), ["_scope", "_pivot"]).select("_scope", "_pivot", tile.alias("_tile"), "_id", "embedding"), centres.withColumn("_tiles", F.ceil(F.col("_n") / rows))


def _cogrouped(left, right, keys, function, schema):
    """Blocks of two tables that meet in a task, as Arrow tables; blocks that only one side has give nothing."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(one, other):
        made = function(one, other) if one.num_rows and other.num_rows else None
        return arrow.empty_table() if made is None else pa.table(made, schema=arrow)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _matrix(table):
    flat = table.column("embedding").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _nearest(vectors, pivots):
    v, p = _matrix(vectors), _matrix(pivots)
    nearest = np.argmax(v @ p.T - (p * p).sum(axis=1) / 2, axis=1)
    return [
        vectors.column("_scope"), pivots.column("_pivot").take(pa.array(nearest)), vectors.column("_id"), vectors.column("embedding"),
        pa.array(np.sqrt(((v - p[nearest]) ** 2).sum(axis=1))),
    ]


def _bounds(asked, centres, blocks):
    """(_scope, _query, _pivot, _bound, _n, _tiles): the highest score that a partition may hold for a query."""
    right = centres.join(blocks, "_scope").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    kind = dict(asked.dtypes)["_id"]

    def meet(queries, centres):
        q, c = _matrix(queries), _matrix(centres)
        radius = centres.column("_radius").to_numpy()
        bound = q @ c.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius + 1e-9  # above any rounding
        i, j = (pa.array(x.ravel()) for x in np.indices(bound.shape))
        return [queries.column("_scope").take(i), queries.column("_id").take(i), centres.column("_pivot").take(j), pa.array(bound.ravel()), centres.column("_n").take(j), centres.column("_tiles").take(j)]

    return _cogrouped(asked, right, ["_scope", "_block"], meet, f"_scope string, _query {kind}, _pivot int, _bound double, _n long, _tiles long")


def _visit(visits, asked, members, k):
    """The best k of every visited tile for every visiting query: (_query, _id, _cos)."""
    wanted = visits.select("_scope", F.col("_query").alias("_id"), "_pivot", "_tiles").join(asked, ["_scope", "_id"])
    right = wanted.withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))).drop("_tiles")
    left = members.join(wanted.select("_scope", "_pivot", F.col("_block").alias("_asking")).distinct(), ["_scope", "_pivot"])
    left, right = left.withColumnRenamed("_asking", "_block"), right.select(*[F.col(c).alias(c) for c in right.columns])
    kinds = dict(asked.dtypes)["_id"], dict(members.dtypes)["_id"]

    def best(members, queries):
        ids = members.column("_id").to_numpy()
        ids = ids.astype(str) if ids.dtype == object else ids
        scores = np.round(_matrix(queries) @ _matrix(members).T, 12)
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(scores), -np.inf)
        asking, found, kept = [], [], []
        for row in range(len(scores)):
            near = np.flatnonzero(scores[row] >= floor[row])
            near = near[np.lexsort((ids[near], -scores[row][near]))[:k]]
            asking.append(np.full(len(near), row))
            found.append(near)
            kept.append(scores[row][near])
        return [queries.column("_id").take(pa.array(np.concatenate(asking))), members.column("_id").take(pa.array(np.concatenate(found))), pa.array(np.concatenate(kept))]

    return _cogrouped(left, right, ["_scope", "_pivot", "_tile", "_block"], best, f"_query {kinds[0]}, _id {kinds[1]}, _cos double")
