"""Exact top-k inner products by block-at-a-time pruning.

Vectors of whole numbers are put in an order in which neighbours have the same large components, and cut into blocks
with the maxima and minima of each component.  For a query, a block's bound is the sum of its extreme products; blocks
are scored in order of bound, through their own rows, until the next bound is below the query's k-th score.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window, functions as F

from .tables import stored

#: Vectors of a block, blocks of a tile (what one task scores at a time), queries of a tile.
BLOCK, TILE_BLOCKS, QUERIES = 64, 128, 512
INDEX = "part int, dim int, ids binary, vectors binary, maxima binary, minima binary"
ANSWERS = "query_id long, vec_id long, score long"


def whole_numbers(vectors, scale=256.0):
    """vectors(vec_id, embedding) -> (vec_id, vector as bytes of int64, lead): floor(scale * x) of every component.

    Rows whose id is null, or whose vector is null or holds a null or a number that isn't finite, take no part.
    `lead` orders vectors: it is the place and sign of the two largest components.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))

    def run(batches):
        for batch in batches:
            numbers = [np.floor(v.values.to_numpy(zero_copy_only=False) * scale).astype(np.int64) for v in batch.column("v")]
            lead = []
            for v in numbers:
                top = np.argsort(-np.abs(v), kind="stable")[:2]
                lead.append(sum((2 * int(t) + int(v[t] < 0) + 1) << (20 * (1 - i)) for i, t in enumerate(top)))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "vector": pa.array([v.tobytes() for v in numbers], pa.binary()), "lead": pa.array(lead, pa.int64())})

    return rows.mapInArrow(run, "vec_id long, vector binary, lead long")


def _matrix(vectors, dim):
    """Rows of int64; components that a shorter vector lacks are 0."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        row = np.frombuffer(v, np.int64)
        out[i, : len(row)] = row
    return out


def build_index(rows):
    """Tiles of blocks from the rows of `whole_numbers`, as a stored table."""
    ordered = rows.repartitionByRange("lead", "vec_id").sortWithinPartitions("lead", "vec_id").select("vec_id", "vector")

    def run(batches):
        part, ids, vectors = TaskContext.get().partitionId(), [], []

        def tile():
            dim = max(len(v) for v in vectors) // 8
            x = _matrix(vectors, dim)
            cuts = np.arange(0, len(x), BLOCK)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "vectors": [x.tobytes()],
                "maxima": [np.maximum.reduceat(x, cuts, axis=0).tobytes()], "minima": [np.minimum.reduceat(x, cuts, axis=0).tobytes()],
            })

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) == BLOCK * TILE_BLOCKS:
                    yield tile()
                    ids, vectors = [], []
        if ids:
            yield tile()

    return stored(ordered.mapInArrow(run, INDEX), "tiles")


def products(a, b):
    """a @ b.T, exactly: in floating point where every sum fits its 53 bits, else in whole numbers of any size."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)


def best_of_tile(queries, query_ids, x, ids, maxima, minima, k):
    """(query, id, score) of each query's k best rows of a tile, ties to the smaller id, and how many blocks were scored.

    In every round each query whose next bound isn't below its k-th score takes that block; queries that take the same
    block are scored together.
    """
    lowest = -np.iinfo(np.int64).max  # its negative is a number, too
    bounds = products(np.maximum(queries, 0), maxima) + products(np.minimum(queries, 0), minima)
    order = np.argsort(-bounds, axis=1, kind="stable")
    scores = np.full((len(queries), k), lowest)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    active, scored = np.arange(len(queries)), 0
    for r in range(bounds.shape[1]):
        active = active[bounds[active, order[active, r]] >= scores[active, -1]]
        if not len(active):
            break
        taken = order[active, r]
        for block in np.unique(taken):
            own = active[taken == block]
            at = slice(block * BLOCK, (block + 1) * BLOCK)
            new = products(queries[own], x[at])
            there = np.broadcast_to(ids[at], new.shape)
            new = np.where(there == query_ids[own][:, None], lowest, new)
            some = (new >= scores[own, -1:]).any(axis=1) & (new.max(axis=1) > lowest)
            own = own[some]
            both = np.concatenate((scores[own], new[some]), axis=1)
            names = np.concatenate((found[own], there[some]), axis=1)
            names = np.where(both == lowest, np.iinfo(np.int64).max, names)
            best = np.lexsort((names, -both), axis=1)[:, :k]
            scores[own], found[own] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
            scored += len(own)
    kept = scores > lowest
    return np.repeat(query_ids, kept.sum(axis=1)), found[kept], scores[kept], scored


def search(index, queries, k=5):
    """The k best vectors of the index for each query (rows of `whole_numbers`): query_id, rank, vec_id, score.

    Vectors with the query's id are its own and no candidates.  Queries of one id are the smallest of their vectors.
    Equal scores rank by vec_id; a query with fewer candidates gets all.  Query tiles meet index tiles in a join on the
    index part; a task holds one pair of tiles.
    """
    last = index.agg(F.max("part")).first()[0]
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    if last is None:
        return asked.limit(0).selectExpr("vec_id as query_id", "0 as rank", "vec_id", "vec_id as score")
    n_tiles = 1 + asked.count() // QUERIES
    tiles = (
        asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_tiles))).agg(F.collect_list(F.struct("vec_id", "vector")).alias("asked"))
        .select("asked", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part"))
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked = batch.column("asked")[i].as_py()
                dim = max([batch.column("dim")[i].as_py(), *(len(q["vector"]) // 8 for q in asked)])
                names = np.array([q["vec_id"] for q in asked], np.int64)
                wide = lambda c, d=batch.column("dim")[i].as_py(), w=dim: np.pad(np.frombuffer(batch.column(c)[i].as_buffer(), np.int64).reshape(-1, d) if d else np.zeros((0, 0), np.int64), ((0, 0), (0, w - d)))  # noqa: E731, B023
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                x, most, least = wide("vectors"), wide("maxima"), wide("minima")
                if not len(x):
                    x = np.zeros((len(ids), dim), np.int64)
                    most = least = np.zeros((-(-len(ids) // BLOCK), dim), np.int64)
                query, vec, score, _ = best_of_tile(_matrix([q["vector"] for q in asked], dim), names, x, ids, most, least, k)
                yield pa.RecordBatch.from_pydict({"query_id": query, "vec_id": vec, "score": score})

    answers = tiles.join(index, "part").select("asked", "dim", "ids", "vectors", "maxima", "minima").mapInArrow(run, ANSWERS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
