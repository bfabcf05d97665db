"""Benchmark decontamination by a positional inverted index of the documents.

The index is distributed by documents: a row is a block of documents with, for each of its terms, the positions of
the term in the block, ascending.  A window of benchmark words is looked up in a block by intersecting its terms'
positions, each less the term's offset in the window, from the block's rarest term on.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .tables import WORD_BYTES, free_name, stored, text_bytes, trimmed

#: Words of a block; a document is never cut, so a block holds one document at least.
BLOCK_WORDS = 1_000_000
#: Positions left free between documents, so that no window reaches into the next one.
GAP = 32
#: Bytes of benchmark text that are looked up in one pass over the index: the bound of what is sent to every task.
SLICE_BYTES = 2 << 20

INDEX = "block long, doc_ids array<long>, ties array<long>, starts array<int>, sizes array<int>, terms array<binary>, term_starts array<int>, positions binary"


def words(text):
    """Words of a text given as bytes: A-Z lower-cased, then runs of a-z, 0-9 and what lies beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def _block(number, docs):
    """An index row of (doc_id, tie, words) triples."""
    ids, terms, starts, sizes, at = [], {}, [], [], 0
    for _, _, own in docs:
        starts.append(at)
        sizes.append(len(own))
        ids.append(np.fromiter((terms.setdefault(w, len(terms)) for w in own), np.int32, len(own)))
        at += len(own) + GAP
    ids = np.concatenate(ids)
    places = np.concatenate([np.arange(s, s + n, dtype=np.int32) for s, n in zip(starts, sizes)])
    order = np.argsort(ids, kind="stable")
    return {
        "block": number, "doc_ids": [d for d, _, _ in docs], "ties": [t for _, t, _ in docs], "starts": starts, "sizes": sizes, "terms": list(terms),
        "term_starts": np.searchsorted(ids[order], np.arange(len(terms) + 1)).tolist(), "positions": places[order].tobytes(),
    }


def build_index(docs, keep=True):
    """The index of docs(doc_id, text); a null text has no words.  No documents give no blocks.

    Built in the scan, without a shuffle.  `keep` stores it, for several searches; else it is built when it is read.
    """

    def run(batches):
        base, number, kept, size = TaskContext.get().partitionId() << 32, 0, [], 0
        schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ties", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("term_starts", pa.list_(pa.int32())), ("positions", pa.binary())])
        for batch in batches:
            for doc_id, tie, text in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), batch.column("text")):
                own = words(text.as_py())
                kept.append((doc_id, tie, own))
                size += len(own)
                if size >= BLOCK_WORDS or len(kept) >= BLOCK_WORDS:
                    yield pa.RecordBatch.from_pylist([_block(base + number, kept)], schema)
                    number, kept, size = number + 1, [], 0
        if kept:
            yield pa.RecordBatch.from_pylist([_block(base + number, kept)], schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), text_bytes().alias("text"))
    index = rows.mapInArrow(trimmed(run), INDEX)
    return stored(index, "positions") if keep else index


def compiled(items, length, least):
    """Query of (item_id, text) rows: its terms, and by window length the terms' numbers and the item of each window."""
    vocabulary, by_length = {}, {}
    for item, text in items:
        own = words(text)
        if len(own) < max(least, 1):
            continue
        size = min(length, len(own))
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in own]
        for i in range(len(ids) - size + 1):
            by_length.setdefault(size, {}).setdefault((tuple(ids[i : i + size]), item))
    return list(vocabulary), [
        (size, np.array([w for w, _ in windows], np.int32).reshape(len(windows), size), [i for _, i in windows]) for size, windows in by_length.items()
    ]


def looked_up(row, query, slop):
    """Occurrences of the query's windows in a block: (start, length, item, exact) with starts as block positions."""
    vocabulary, groups = query
    slots = {t: i for i, t in enumerate(row["terms"])}
    slots = np.array([slots.get(t, -1) for t in vocabulary], np.int64)
    starts = np.asarray(row["term_starts"], np.int64)
    counts = np.where(slots >= 0, starts[slots + 1] - starts[slots], 0)
    positions = np.frombuffer(row["positions"], np.int32)
    lists = lambda t: positions[starts[slots[t]] : starts[slots[t] + 1]]
    for size, windows, items in groups:
        frequency = counts[windows]
        for w in np.flatnonzero(frequency.min(axis=1) > 0):
            order = np.argsort(frequency[w], kind="stable")
            rarest = lists(windows[w, order[0]]) - order[0]
            at = rarest if slop == 0 else np.unique(rarest[:, None] + np.arange(-slop, slop + 1))
            moved = np.zeros(len(at), bool) if slop == 0 else ~np.isin(at, rarest, assume_unique=True)
            for k in order[1:]:
                there = lists(windows[w, k]) - k
                j = np.searchsorted(there, at)
                apart = np.minimum(np.abs(there[np.minimum(j, len(there) - 1)] - at), np.abs(there[np.maximum(j - 1, 0)] - at))
                keep = apart <= slop
                at, moved = at[keep], moved[keep] | (apart[keep] > 0)
                if not len(at):
                    break
            if len(at):
                yield at, size, items[w], ~moved


def search(index, items, length=10, least=1, slop=2):
    """Matches of items(item_id, text) in the index, a row per document row and item.

    Columns: block, place (of the document in it), doc_id, tie (hash of the text), item_id as string, spans array<struct<start, end>> of words that
    lie in an exact phrase match (none: the item has near matches only).  A near match is a place from which every
    word of a window is at most `slop` places away from where it belongs.  A window is `length` words in a row; a shorter item is one window, items of fewer than `least` words are left out.  Null texts have no words, and
    equal rows count once.  Items are looked up in slices of bounded size, one pass over the index each.
    """
    assert 2 * slop + 1 < GAP
    spark = index.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = 1 + total // SLICE_BYTES
    found = []
    for k in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        query = spark.sparkContext.broadcast(compiled(sorted(((r["item_id"], bytes(r["text"])) for r in rows), key=str), length, least))

        def run(batches, query=query):
            for batch in batches:
                for number in range(batch.num_rows):
                    row = {c: batch.column(c)[number] for c in ("block", "terms", "term_starts", "positions", "starts", "doc_ids", "ties")}
                    row = {c: v.values.to_numpy(zero_copy_only=False) if c in ("term_starts", "starts") else v.as_py() for c, v in row.items()}
                    spans = {}
                    for at, size, item, exact in looked_up(row, query.value, slop):
                        # a near match may begin before its document: the gap before it is wide enough to tell
                        places = np.searchsorted(row["starts"], at + slop, "right") - 1
                        for place, start, own in zip(places.tolist(), at.tolist(), exact.tolist()):
                            kept = spans.setdefault((place, item), [])
                            if own:
                                kept.append((start - int(row["starts"][place]), size))
                    out = []
                    for (place, item), kept in spans.items():
                        merged = []
                        for start, size in sorted(kept):
                            if merged and start <= merged[-1]["end"]:
                                merged[-1]["end"] = max(merged[-1]["end"], start + size)
                            else:
                                merged.append({"start": start, "end": start + size})
                        out.append({"block": row["block"], "place": place, "doc_id": row["doc_ids"][place], "tie": row["ties"][place], "item_id": item, "spans": merged})
                    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("item_id", pa.string()), ("spans", pa.list_(span))]))

        found.append(stored(index.mapInArrow(trimmed(run), "block long, place int, doc_id long, tie long, item_id string, spans array<struct<start:int,end:int>>"), "matches"))
        query.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def judged(index, matches):
    """Every document row of the index: doc_id, tie, n_words, n_hit (words inside exact matches), items, near_items.

    Item ids are distinct and sorted; an item without id hits words but isn't counted.
    """
    docs = (
        index.select("block", F.posexplode(F.arrays_zip("doc_ids", "ties", "sizes")).alias("place", "doc"))
        .select("block", "place", "doc.doc_ids", "doc.ties", "doc.sizes").toDF("block", "place", "doc_id", "tie", "n_words")
    )
    covered = lambda spans: F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
        lambda a: a["n"],
    )
    hits = matches.groupBy("block", "place").agg(
        covered(F.flatten(F.collect_list("spans"))).alias("n_hit"),
        F.array_sort(F.collect_set(F.when(F.size("spans") > 0, F.col("item_id")))).alias("items"),
        F.array_sort(F.collect_set("item_id")).alias("near_items"),
    )
    none = F.array().cast("array<string>")
    return docs.join(hits, ["block", "place"], "left").select(
        "doc_id", "tie", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
    )


def clean_documents(docs, items, length=10, least=5):
    """The documents without a word inside an exact match.  Items of fewer than `least` words are met by chance and left out.

    Rows are told apart by doc_id and the hash of their text; all columns are kept.
    """
    tie, bad_id, bad_tie = (free_name(docs, name) for name in ("tie", "bad_id", "bad_tie"))
    found = search(build_index(docs, keep=False), items, length, least, 0).filter(F.size("spans") > 0)
    bad = found.select(F.col("doc_id").alias(bad_id), F.col("tie").alias(bad_tie)).distinct()
    tied = docs.withColumn(tie, F.xxhash64("text"))
    return tied.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(tie) == F.col(bad_tie)), "left_anti").drop(tie)
