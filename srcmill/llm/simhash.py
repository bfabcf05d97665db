"""Near-duplicates by SimHash fingerprints, linked by a generalised pigeonhole.

The 64 bits are grouped into parts of correlated bits.  If the thresholds of the parts sum to radius - parts + 1, two
fingerprints within the radius are within the threshold on some part.  Every fingerprint gets its own thresholds, by
dynamic programming on the candidates that it is estimated to meet; it probes each part's values within them, and
what meets in a value is verified.
"""

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .components import components
from .tables import free_name, stored, text_bytes, trimmed

BITS = 64
#: Shingles hashed at once, to bound memory.
CHUNK = 1 << 16
#: Most fingerprints of a bucket that are compared in one piece; larger buckets are cut.
CELL = 1024
#: Bits of a group whose values are counted, for the estimates.
COUNTED = 8


def simhash(text, shingle=3, seed=42):
    """Fingerprint of a text, given as bytes, as 8 bytes: words are cut at ASCII white space after lower-casing A-Z."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    short = max(0, min(shingle, len(words)) - 1)
    starts, ends = starts[: len(starts) - short].tolist(), ends[short:].tolist()
    votes, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for i in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(starts)).tobytes()


def fingerprint(text="text", shingle=3, seed=42):
    """Column: the fingerprint as a long; a null text has no words, and a text without words has fingerprint 0."""

    @F.pandas_udf("long")
    @trimmed
    def computed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.frombuffer(b"".join([simhash(t, shingle, seed) for t in texts]), ">i8").astype("i8"))

    return computed(text_bytes(text))


def bit_counts(prints):
    """How often two bits are set together, as a 64 x 64 matrix, over all rows of prints(fp)."""

    def partial(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                bits = unpacked(batch.column("fp").slice(i, 8192).to_numpy().view(np.uint64)).astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(BITS * BITS), "n": total.ravel()})

    rows = prints.select("fp").mapInArrow(trimmed(partial), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    matrix = np.zeros(BITS * BITS, np.int64)
    for r in rows:
        matrix[r["cell"]] = r["n"]
    return matrix.reshape(BITS, BITS)


def unpacked(prints):
    """Bits of unsigned fingerprints, lowest first, a row each."""
    return np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(together, n, parts):
    """Bits by part: each part grows from the bit with most correlation left by the bits nearest to its members."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    related = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, groups = list(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        group = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (related[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(group)
    return groups


def value_shares(prints, groups, n):
    """For each part and each 8 of its bits, the share of each value, over all rows."""
    cuts = [[g[i : i + COUNTED] for i in range(0, len(g), COUNTED)] for g in groups]
    flat = [c for part in cuts for c in part]

    def partial(batches):
        total = np.zeros((len(flat), 1 << COUNTED), np.int64)
        for batch in batches:
            bits = unpacked(batch.column("fp").to_numpy().view(np.uint64))
            for k, cut in enumerate(flat):
                total[k] += np.bincount(bits[:, cut] @ (1 << np.arange(len(cut))), minlength=1 << COUNTED)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size), "n": total.ravel()})

    rows = prints.select("fp").mapInArrow(trimmed(partial), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(flat) << COUNTED, np.float64)
    for r in rows:
        counts[r["cell"]] = r["n"]
    shares = iter(counts.reshape(len(flat), -1) / max(n, 1))
    return [[(cut, next(shares)) for cut in part] for part in cuts]


def estimates(bits, part, radius):
    """Share of all fingerprints within 0 to `radius` bits of each one on a part; groups count as independent."""
    values = np.arange(1 << COUNTED)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    out = np.zeros((len(bits), radius + 1))
    out[:, 0] = 1
    for cut, share in part:
        own = bits[:, cut] @ (1 << np.arange(len(cut)))
        table = np.stack([np.where(apart == d, share[None, :], 0).sum(axis=1) for d in range(radius + 1)], axis=1)[own]
        out = np.stack([sum(out[:, j] * table[:, d - j] for j in range(d + 1)) for d in range(radius + 1)], axis=1)
    return np.cumsum(out, axis=1)


def thresholds(costs, radius):
    """For each row the thresholds (-1: the part isn't probed) that sum to radius - parts + 1 at least cost.

    costs[part] has a column per threshold 0, 1, ..., radius; -1 costs nothing.  Dynamic programming over the parts.
    """
    parts, n = len(costs), len(costs[0])
    wanted = radius - parts + 1
    sums = range(-parts, wanted + parts)
    best = {0: np.zeros(n)}
    chosen = []
    for cost in costs:
        then, by = {}, {}
        for s in sums:
            options = [(best[s - t] + (cost[:, t] if t >= 0 else 0), t) for t in range(-1, radius + 1) if s - t in best]
            if options:
                stacked = np.stack([o for o, _ in options])
                at = stacked.argmin(axis=0)
                then[s], by[s] = stacked.min(axis=0), np.array([t for _, t in options])[at]
        best = then
        chosen.append(by)
    out, left = np.zeros((n, parts), np.int64), np.full(n, wanted)
    for p in reversed(range(parts)):
        for s in np.unique(left):
            rows = left == s
            out[rows, p] = chosen[p][s][rows]
        left = left - out[:, p]
    return out


def probes(prints, groups, shares, n, radius, probe_cost=1.0):
    """Rows (part, value, fp, own): each fingerprint in its own value of every part, and in those that it probes."""
    masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
    flips = [[np.array([np.uint64(sum(1 << b for b in c)) for c in combinations(g, k)], np.uint64) for k in range(radius + 1)] for g in groups]
    tried = [np.cumsum([comb(len(g), k) for k in range(radius + 1)]) for g in groups]

    def run(batches):
        def rows(part, values, fps, own):
            return pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(fps), part, np.int8)), "value": values.view(np.int64), "fp": fps.view(np.int64), "own": np.full(len(fps), own),
            })

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                fps = batch.column("fp").slice(i, 2048).to_numpy().view(np.uint64)
                bits = unpacked(fps)
                costs = [probe_cost * t + n * estimates(bits, s, radius) for t, s in zip(tried, shares)]
                limits = thresholds(costs, radius)
                for p, mask in enumerate(masks):
                    values = fps & mask
                    yield rows(p, values, fps, True)
                    for k in range(1, radius + 1):
                        some = limits[:, p] >= k
                        if some.any():
                            near = (values[some][:, None] ^ flips[p][k][None, :]).ravel()
                            yield rows(p, near, np.repeat(fps[some], len(flips[p][k])), False)

    return prints.select("fp").mapInArrow(trimmed(run), "part byte, value long, fp long, own boolean")


def joined_nodes(a, b, radius):
    """Links between nodes a and b (or among a, if b is None) as a forest: each node with the first of its component."""
    if b is None:
        near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
        label = np.arange(len(a))
        while True:
            new = np.where(near, label[None, :], len(a)).min(axis=1)
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(a))
        return a[moved], a[label[moved]]
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if not near.any():
        return a[:0], a[:0]
    big = len(a)
    label = np.arange(big)
    while True:
        right = np.where(near, label[:, None], big).min(axis=0)
        new = np.minimum(label, np.where(near, right[None, :], big).min(axis=1))
        if (new == label).all():
            break
        label = new
    moved, met = label != np.arange(big), right < big
    return np.concatenate((a[moved], b[met])), np.concatenate((a[label[moved]], a[right[met]]))


def links(prints, radius=3, parts=2):
    """prints(fp), distinct -> edges(u, v) whose components are those of all pairs within the radius.

    A bucket (a value of a part) holds the fingerprints that have or probe the value.  Large buckets are cut into
    cells by hash and compared cell by cell; a comparison returns a forest, so a dense group gives a linear number of
    edges.
    """
    n = prints.count()
    groups = grouped_bits(bit_counts(prints), n, parts)
    rows = probes(prints, groups, value_shares(prints, groups, n), n, radius)
    own = rows.filter("own").select("part", "value", "fp")
    owned = own.select("part", "value").distinct()
    hits = rows.filter("not own").select("part", "value", "fp").join(owned, ["part", "value"], "left_semi")
    members = stored(own.unionByName(hits), "buckets")
    sizes = members.groupBy("part", "value").agg(F.count("*").alias("n")).filter("n > 1")
    cells = (
        members.join(sizes, ["part", "value"])
        .withColumn("cell", F.expr(f"pmod(xxhash64(fp), cast(ceil(n / {CELL}) as bigint))"))
        .groupBy("part", "value", "cell").agg(F.collect_list("fp").alias("fps"))
    )
    cells = stored(cells, "cells")
    alone = cells.filter(F.size("fps") > 1).select(F.col("fps").alias("a"), F.lit(None).cast("array<bigint>").alias("b"))
    other = cells.select("part", "value", F.col("cell").alias("cell_b"), F.col("fps").alias("b"))
    across = cells.join(other, ["part", "value"]).filter("cell < cell_b").select(F.col("fps").alias("a"), "b")

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a = a.values.to_numpy().view(np.uint64)
                if len(a) == 2 and not b.is_valid:
                    if int(a[0] ^ a[1]).bit_count() <= radius:
                        us.append(a[:1])
                        vs.append(a[1:])
                    continue
                u, v = joined_nodes(a, b.values.to_numpy().view(np.uint64) if b.is_valid else None, radius)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_pydict({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    return alone.unionByName(across).mapInArrow(trimmed(compare), "u long, v long")


def classes(rows, radius=3, parts=2):
    """rows(doc_id, fp) -> (fp, root, component_id): for each fingerprint its component and the smallest doc_id in it.

    Equal fingerprints are reduced before anything is compared.  Null ids count only where a component has no other;
    its component_id is then null.  No rows give no rows.
    """
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(firsts.select("fp"), radius, parts))
    named = stored(firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs, shingle=3, radius=3, parts=2):
    """docs(doc_id, text) -> (doc_id, fp, component_id), a row per row of docs."""
    rows = stored(docs.select("doc_id", fingerprint("text", shingle).alias("fp")), "fingerprints")
    return rows.join(classes(rows, radius, parts).select("fp", "component_id"), "fp")


def first_of_each(docs, shingle=3, radius=3, parts=2):
    """The documents with one row left of each component: that of the smallest doc_id (null last), then smallest hash.

    Of rows that are equal in doc_id and text one stays.
    """
    # rows are told apart by id and text; both meet in one column, so that the join and the last step share a shuffle
    name = lambda d, t: F.concat(F.coalesce(d.cast("string"), F.lit("")), F.lit(":"), t.cast("string"))
    rows = stored(docs.select("doc_id", fingerprint("text", shingle).alias("fp"), F.xxhash64("text").alias("tie")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tie")
    kept = (
        rows.join(classes(rows.select("doc_id", "fp"), radius, parts).select("fp", "root"), "fp")
        .groupBy("root").agg(F.min(order).alias("kept"))
    )
    row, kept_row = free_name(docs, "row"), free_name(docs, "kept_row")
    kept = kept.select(name(F.col("kept.doc_id"), F.col("kept.tie")).alias(kept_row))
    named = docs.withColumn(row, name(F.col("doc_id"), F.xxhash64("text")))
    return named.join(kept, F.col(row) == F.col(kept_row), "left_semi").dropDuplicates([row]).drop(row)
