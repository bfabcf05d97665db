"""Long repeats between and within documents, by a logarithmic family of sparse suffix arrays.

A suffix array here holds the suffixes that start at anchors: places whose 32-byte gram has the smallest hash of some
69 grams in a row.  Every string of 100 bytes contains an anchor that depends on the string alone, so equal strings
meet at equal anchors.  Entries are sorted by the gram and then by the context around it, both as 64-bit hashes, and
only the first entry of each context is kept, already where texts are read: what isn't the first there is a repeat.  Documents come in batches of ascending doc_id.  A batch's array is
merge-scanned against the levels of earlier batches; levels of equal size are merged.

An anchor whose whole context occurs earlier lies in a repeat.  Where a gram occurs in several contexts, the bytes
around its first occurrences are compared window by window, which gives the exact ends of repeats.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from .tables import stored, text_bytes, trimmed, trimmed_group

GRAM = 32
#: Bytes of text for each part of the key space (a task of a merge scan) and of the documents (a task of a pass).
KEY_BYTES, DOC_BYTES = 16 << 20, 16 << 20
#: Bytes of text whose anchors are packed at once.
FLUSH = 16 << 20
#: Edges of whole grams that are compared at once; a gram of more is compared alone.
COMPARED = 100_000
#: doc_id of a document whose id is null; it comes before all others.
NO_ID = -(2**63)

ENTRIES = "bucket int, old boolean, docs binary, ties binary, owner binary, pos binary, key binary, ctx binary"
FLAGS = "part int, docs binary, ties binary, owner binary, start binary, stop binary, key binary, edge boolean"
FOUND = f"level boolean, {ENTRIES}, part int, start binary, stop binary, edge boolean"
EDGES = "bucket int, docs binary, ties binary, owner binary, pos binary, key binary, left binary, right binary, context binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,stop:int>>"

_P = 0x9E3779B97F4A7C15


def _slide(values, width, least):
    """Smallest (or largest) of each `width` neighbours."""
    pick, n = np.minimum if least else np.maximum, 1
    while 2 * n <= width:
        values = pick(values[:-n], values[n:])
        n *= 2
    return pick(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def anchors(data, match):
    """Places of the anchors of a text and the hashes of their grams."""
    if len(data) < match:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, p, n = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), _P, 1
    while n < GRAM:
        h = h[:-n] * np.uint64(p) + h[n:]
        p, n = p * p % 2**64, 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width = match - GRAM + 1
    border = np.zeros(width - 1, np.uint64)
    least = np.concatenate((border, _slide(h, width, True), border))
    at = np.flatnonzero(h == _slide(least, width, False))
    return at, h[at]


def _packed(docs, ties, owner, **arrays):
    """A row's binary columns, with the documents that it mentions."""
    own, index = np.unique(owner, return_inverse=True)
    return {"docs": docs[own].tobytes(), "ties": ties[own].tobytes(), "owner": index.astype(np.int32).tobytes(), **{k: v.tobytes() for k, v in arrays.items()}}


def _unpacked(table, **kinds):
    """Arrays over all rows of packed columns: document id and tie of each entry, then the named columns."""
    got = {k: [] for k in ("doc", "tie", *kinds)}
    for i in range(table.num_rows):
        owner = np.frombuffer(table.column("owner")[i].as_buffer(), np.int32)
        got["doc"].append(np.frombuffer(table.column("docs")[i].as_buffer(), np.int64)[owner])
        got["tie"].append(np.frombuffer(table.column("ties")[i].as_buffer(), np.int32)[owner])
        for k, kind in kinds.items():
            got[k].append(np.frombuffer(table.column(k)[i].as_buffer(), kind))
    empty = {"doc": np.int64, "tie": np.int32, **kinds}
    return {k: np.concatenate(v) if v else np.empty(0, empty[k]) for k, v in got.items()}


def _by(number, *arrays):
    """For each value of `number`, the value and the rows that have it."""
    order = np.argsort(number, kind="stable")
    values, starts = np.unique(number[order], return_index=True)
    for value, rows in zip(values.tolist(), np.split(order, starts[1:])):
        yield value, rows


def _new(values):
    """Where a sorted array's value isn't the one before."""
    return np.concatenate(([True], values[1:] != values[:-1]))[: len(values)]


def _first(doc, pos, new):
    """Which entries stand at the place of the first of their run; `new` tells where a run begins."""
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc == doc[start]) & (pos == pos[start])


def _part(docs, parts):
    return (docs ^ (docs >> 15)) % parts


def _arrow(rows, ddl):
    """Rows as an Arrow table of the columns of a DDL string."""
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<struct<start:int,stop:int>>": pa.list_(span)}
    return pa.Table.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))]))


class Repeats:
    """An index family over batches of documents.

    `match`: length in bytes of the shortest repeat.  `volume`: bytes of text that the family is laid out for, from
    which the number of tasks follows.
    """

    def __init__(self, spark, volume, match=100):
        self.spark, self.match, self.levels, self.flags = spark, match, [], []
        self.buckets, self.parts = max(8, -(-volume // KEY_BYTES)), max(8, -(-volume // DOC_BYTES))

    def named(self, docs):
        """doc_id, tie (tells texts of one id apart) and text as bytes."""
        return docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_bytes().alias("text")
        ).select("doc_id", F.expr("cast(xxhash64(text) & 2147483647 as int)").alias("tie"), "text")

    def entries(self, docs):
        """The anchors of documents, packed by part of the key space.

        Those whose context occurs earlier in the same packing are repeats: they are dealt over all parts, `old` null.
        """
        match, buckets, side = self.match, self.buckets, self.match - GRAM

        def run(batches):
            digest, held, size = xxhash.xxh3_64_intdigest, [], 0

            def packed():
                lengths = [len(p) for _, _, p, _, _ in held]
                docs, ties = np.array([d for d, *_ in held], np.int64), np.array([t for _, t, *_ in held], np.int32)
                owner = np.repeat(np.arange(len(held)), lengths)
                pos, key, ctx = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
                order = np.lexsort((pos, docs[owner], ctx, key))
                owner, pos, key, ctx = owner[order], pos[order], key[order], ctx[order]
                first = _first(docs[owner], pos, _new(key) | _new(ctx))
                rows, again = [], np.flatnonzero(~first)
                for k, at in enumerate(np.array_split(again, min(8, len(again))) if len(again) else []):
                    bucket = (int(docs[0]) + k * max(1, buckets // 8)) % buckets
                    rows.append({"bucket": bucket, "old": None, **_packed(docs, ties, owner[at], pos=pos[at], key=key[:0], ctx=ctx[:0])})
                kept = np.flatnonzero(first)
                for bucket, at in _by((key[kept] >> np.uint64(24)) % np.uint64(buckets)):
                    at = kept[at]
                    rows.append({"bucket": bucket, "old": False, **_packed(docs, ties, owner[at], pos=pos[at], key=key[at], ctx=ctx[at])})
                return _arrow(rows, ENTRIES)

            for batch in batches:
                for doc_id, tie, text in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text")):
                    text = text.as_py()
                    pos, key = anchors(text, match)
                    ctx = np.fromiter((digest(text[max(0, p - side) : p + match], min(p, side)) for p in pos.tolist()), np.uint64, len(pos))
                    if len(pos):
                        held.append((doc_id, tie, pos.astype(np.int32), key, ctx))
                    size += len(text)
                    if size >= FLUSH and held:
                        yield from packed().to_batches()
                        held, size = [], 0
            if held:
                yield from packed().to_batches()

        return self.named(docs).mapInArrow(trimmed(run), ENTRIES)

    def add(self, docs, keep=True):
        """Merge-scan a batch, whose doc_ids are above those of earlier batches, against the levels.

        Returns the flags of this batch: anchors in repeats as spans to remove, and edges to be resolved.  `keep`
        makes the batch a level of its own, then merges levels while the last two are of one size.
        """
        parts, side, match = self.parts, self.match - GRAM, self.match
        rows = self.entries(docs)
        for _, level in self.levels:
            rows = rows.unionByName(level)

        def scan(table):
            bucket = table.column("bucket")[0].as_py()
            again = _unpacked(table.filter(pc.is_null(table.column("old"))), pos=np.int32)
            table = table.filter(pc.is_valid(table.column("old")))
            a = _unpacked(table, pos=np.int32, key=np.uint64, ctx=np.uint64)
            sizes = [len(table.column("owner")[i].as_buffer()) // 4 for i in range(table.num_rows)]
            old = np.repeat(np.array(table.column("old").to_pylist(), bool), sizes)
            order = np.lexsort((a["pos"], a["doc"], a["ctx"], a["key"]))
            a, old = {k: v[order] for k, v in a.items()}, old[order]
            doc, pos, key, ctx = a["doc"], a["pos"], a["key"], a["ctx"]
            new_key = _new(key)
            new_ctx = new_key | _new(ctx)
            first = _first(doc, pos, new_ctx)
            group = np.cumsum(new_key) - 1
            contexts, fresh = np.bincount(group, new_ctx), np.bincount(group, first & ~old)
            edge = first & (contexts[group] > 1) & (fresh[group] > 0)
            some = ~first & ~old
            again = {k: np.concatenate((v, a[k][some])) for k, v in again.items()}
            out = []
            for part, at in _by(_part(again["doc"], parts)):
                start = again["pos"][at]
                out.append({"level": False, "part": part, "edge": False, "bucket": bucket, **_packed(
                    again["doc"], again["tie"], at, start=start - np.int32(side), stop=start + np.int32(match), key=key[:0],
                )})
            some = np.flatnonzero(edge)
            for part, at in _by(_part(doc[some], parts)):
                at = some[at]
                out.append({"level": False, "part": part, "edge": True, "bucket": bucket, **_packed(
                    doc, a["tie"], at, start=pos[at], stop=pos[at] + np.int32(match), key=key[at],
                )})
            at = np.flatnonzero(first & ~old)
            if keep and len(at):
                out.append({"level": True, "bucket": bucket, "old": True, **_packed(doc, a["tie"], at, pos=pos[at], key=key[at], ctx=ctx[at])})
            return _arrow(out, FOUND)

        found = stored(rows.groupBy("bucket").applyInArrow(trimmed_group(scan), FOUND), "merge-scan")
        flags = found.filter("not level").select("part", "docs", "ties", "owner", "start", "stop", "key", "edge")
        self.flags.append(flags)
        if keep:
            self.levels.append((1, found.filter("level").select("bucket", "old", "docs", "ties", "owner", "pos", "key", "ctx")))
            while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
                (size, a), (_, b) = self.levels.pop(), self.levels.pop()
                self.levels.append((2 * size, stored(self._merged(a.unionByName(b)), "level")))
        return flags

    def _merged(self, rows):
        """One sorted run a bucket."""

        def merge(table):
            a = _unpacked(table, pos=np.int32, key=np.uint64, ctx=np.uint64)
            at = np.lexsort((a["pos"], a["doc"], a["ctx"], a["key"]))
            return _arrow([{"bucket": table.column("bucket")[0].as_py(), "old": True, **_packed(a["doc"], a["tie"], at, pos=a["pos"][at], key=a["key"][at], ctx=a["ctx"][at])}], ENTRIES)

        return rows.groupBy("bucket").applyInArrow(trimmed_group(merge), ENTRIES)

    def removed(self, docs):
        """The documents of all batches with the bytes that repeats cover: columns of RESULT, a row per row of docs."""
        flags = self.flags[0]
        for more in self.flags[1:]:
            flags = flags.unionByName(more)
        parts, cells, match, side = self.parts, 2 * self.buckets, self.match, self.match - GRAM
        texts = self.named(docs).withColumn("part", F.expr(f"cast(pmod(doc_id ^ shiftright(doc_id, 15), {parts}) as int)"))

        def contexts(texts, flags):
            e = _unpacked(flags, start=np.int32, key=np.uint64)
            known = {}
            for doc_id, tie, text in zip(texts.column("doc_id").to_pylist(), texts.column("tie").to_pylist(), texts.column("text")):
                known.setdefault((doc_id, tie), text)
            order = np.lexsort((e["start"], e["tie"], e["doc"]))
            doc, tie, pos, key = e["doc"][order], e["tie"][order], e["start"][order], e["key"][order]
            again = np.concatenate(([False], (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (pos[1:] == pos[:-1]))) if len(doc) else np.empty(0, bool)
            doc, tie, pos, key = doc[~again], tie[~again], pos[~again], key[~again]
            tables = [_arrow([], EDGES)]
            for cell, at in _by((key >> np.uint64(24)) % np.uint64(cells)):
                left, right = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint8)
                context = np.zeros((len(at), match + side), np.uint8)
                last, text = None, None
                for i, (d, t, p) in enumerate(zip(doc[at].tolist(), tie[at].tolist(), pos[at].tolist())):
                    if (d, t) != last:
                        last, text = (d, t), np.frombuffer(known[d, t].as_buffer(), np.uint8)
                    begin, end = max(0, p - side), min(len(text), p + match)
                    left[i], right[i] = p - begin, end - p - GRAM
                    context[i, side - (p - begin) : side + end - p] = text[begin:end]
                tables.append(_arrow([{"bucket": cell, **_packed(doc, tie, at, pos=pos[at], key=key[at], left=left, right=right, context=context)}], EDGES))
            return pa.concat_tables(tables)

        def resolve(table):
            e = _unpacked(table, pos=np.int32, key=np.uint64, left=np.uint8, right=np.uint8)
            around = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, match + side) for x in table.column("context")]
            row = np.repeat(np.arange(len(around)), [len(x) for x in around])
            within = np.concatenate([np.arange(len(x)) for x in around])
            order = np.lexsort((e["pos"], e["doc"], e["key"]))
            e = {k: v[order] for k, v in e.items()}
            row, within = row[order], within[order]
            least, most = np.full(len(order), match), np.full(len(order), -1)
            # whole grams, at least COMPARED edges but for the last
            grams = np.append(np.flatnonzero(_new(e["key"])), len(order)).tolist()
            start = 0
            for stop, beyond in zip(grams[1:], [*grams[2:], None]):
                if beyond is None or beyond - start > COMPARED:
                    context = np.empty((stop - start, match + side), np.uint8)
                    for k, at in _by(row[start:stop]):
                        context[at] = around[k][within[start:stop][at]]
                    least[start:stop], most[start:stop] = compared({k: v[start:stop] for k, v in e.items()}, context)
                    start = stop
            some = np.flatnonzero(most >= 0)
            doc, pos = e["doc"], e["pos"]
            out = []
            for part, at in _by(_part(doc[some], parts)):
                at = some[at]
                out.append({"part": part, "edge": False, **_packed(
                    doc, e["tie"], at, start=(pos[at] - most[at]).astype(np.int32), stop=(pos[at] - least[at] + match).astype(np.int32), key=e["key"][:0],
                )})
            return _arrow(out, FLAGS)

        def compared(e, context):
            """Fewest and most bytes before its gram in an edge's windows that occur earlier; `most` is -1 if none does."""
            doc, pos, left, right = e["doc"], e["pos"], e["left"].astype(int), e["right"].astype(int)
            least, most = np.full(len(pos), match), np.full(len(pos), -1)
            power = np.uint64(pow(_P, match - 1, 2**64))
            h = np.zeros(len(pos), np.uint64)
            for c in range(match):
                h = h * np.uint64(_P) + context[:, c]
            for begin in range(side + 1):  # the window that starts at this column, `before` bytes before the gram
                if begin:
                    h = (h - context[:, begin - 1] * power) * np.uint64(_P) + context[:, begin + match - 1]
                before = side - begin
                rows = np.flatnonzero((before <= left) & (begin <= right))
                mixed = (h[rows] ^ (h[rows] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) ^ e["key"][rows]
                at = np.argsort(mixed, kind="stable")
                rows, mixed = rows[at], mixed[at]
                start = np.maximum.accumulate(np.where(np.concatenate(([True], mixed[1:] != mixed[:-1])), np.arange(len(rows)), 0)) if len(rows) else rows
                first = rows[start]
                again = rows[(doc[rows] != doc[first]) | (pos[rows] != pos[first])]
                least[again], most[again] = np.minimum(least[again], before), np.maximum(most[again], before)
            return least, most

        def cut(texts, flags):
            f = _unpacked(flags, start=np.int32, stop=np.int32)
            order = np.lexsort((f["start"], f["tie"], f["doc"]))
            doc, tie, start, stop = f["doc"][order], f["tie"][order], f["start"][order], f["stop"][order]
            border = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])))) if len(doc) else np.empty(0, int)
            spans = {(int(doc[a]), int(tie[a])): (a, b) for a, b in zip(border.tolist(), [*border[1:].tolist(), len(doc)])}
            out = []
            for doc_id, own, text in zip(texts.column("doc_id").to_pylist(), texts.column("tie").to_pylist(), texts.column("text")):
                text = text.as_py()
                a, b = spans.get((doc_id, own), (0, 0))
                runs = []
                for i, j in zip(np.maximum(start[a:b], 0).tolist(), np.minimum(stop[a:b], len(text)).tolist()):
                    if runs and i <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], j)
                    else:
                        runs.append([i, j])
                kept, at = hashlib.sha256(), 0
                for i, j in runs:
                    kept.update(text[at:i])
                    at = j
                kept.update(text[at:])
                out.append({
                    "doc_id": None if doc_id == NO_ID else doc_id, "n_bytes": len(text), "n_removed": sum(j - i for i, j in runs), "n_spans": len(runs),
                    "kept_sha256": kept.hexdigest(), "removed": [{"start": i, "stop": j} for i, j in runs],
                })
            return _arrow(out, RESULT)

        grouped = texts.groupBy("part")
        edges = grouped.cogroup(flags.filter("edge").groupBy("part")).applyInArrow(trimmed_group(contexts), EDGES)
        resolved = edges.groupBy("bucket").applyInArrow(trimmed_group(resolve), FLAGS)
        spans = flags.filter("not edge").unionByName(resolved)
        return grouped.cogroup(spans.groupBy("part")).applyInArrow(trimmed_group(cut), RESULT)


def repeats(docs, match=100, batches=2):
    """docs(doc_id, text) -> columns of RESULT, a row per row of docs: what repeats of at least `match` bytes cover.

    A byte is removed if a string of `match` bytes that covers it also starts earlier: in a document of smaller
    doc_id, or earlier in the same one.  Null texts are empty, a null id comes first.  Rows of one doc_id are one
    document: equal strings at one place in two of them aren't earlier than each other.  The documents are added in
    `batches` ranges of doc_id.
    """
    ids = docs.select("doc_id").filter("doc_id is not null")
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    family = Repeats(docs.sparkSession, volume, match)
    borders = [None, *(int(c) for c in cuts), None]
    for k, (low, high) in enumerate(zip(borders, borders[1:])):
        rows = docs
        if low is not None:
            rows = rows.filter(F.col("doc_id") >= low)
        if high is not None:
            rows = rows.filter(F.coalesce(F.col("doc_id") < high, F.lit(True))) if low is None else rows.filter(F.col("doc_id") < high)
        family.add(rows, keep=k < len(borders) - 2)
    return family.removed(docs)
