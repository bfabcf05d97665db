"""Spelling variants by a dictionary of trie-node pairs.

Forward trie and reversed trie of the words are numbered; a split of a word is then a pair of integers, its prefix node
and its suffix node, however long the word.  Two words that differ by one replaced letter agree in the pair that skips
the letter; a word agrees with itself plus one letter in a pair that skips the letter there and nothing here.  A pair's
rows are words p + letter + s for fixed p and s, and p + s itself, so no pair has more rows than there are letters.

Tries are numbered in parallel: words are range-partitioned and sorted, each task numbers its own range, and the nodes
that two neighbouring ranges share, prefixes of the words at their border, are then given the earlier range's number.

Documents without text have no words; a null doc_id counts as empty.  Repeated rows count again.  Other columns are
ignored, whatever their names.  No words give no rows.
"""

import re
import string
import zlib
from collections import Counter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .tables import stored

# The letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

#: Different words that a task counts before it hands them on.
COUNTED = 300_000
NUMBERED = "id long, word string, n long, nodes array<long>"


def dropped_letter(doc_id, run):
    """The run without one letter if the CRC-32 of `<doc_id>:<run>` is a multiple of 31: a reproducible misspelling."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs, least_length=7, least_count=2, change=lambda doc_id, run: run, doc_id="doc_id", text="text"):
    """(word, n): words of whole texts, A-Z lower-cased, each changed by `change(doc_id, run)`, which may shorten it.

    Runs shorter than `least_length` aren't looked at; words shorter than that or rarer than `least_count` aren't kept.
    """
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")  # greedy: a match is a whole run

    def count(batches):
        total = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    lowered = Counter()
                    for found, n in Counter(run.findall(whole)).items():
                        lowered[found.lower() if found.isascii() else found.translate(_LOWER)] += n
                    for found, n in lowered.items():
                        word = change(name, found)
                        if len(word) >= least_length:
                            total[word] += n
                if len(total) > COUNTED:
                    yield _counted(total)
                    total = Counter()
        yield _counted(total)

    texts = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("name"), F.col(text).alias("whole")).filter("whole is not null")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(total):
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def _numbered(words, carried=()):
    """Words in sorted order with the numbers of their prefix nodes, by length from 0, and the aliases of shared nodes.

    `id` rises with the word.  `carried` columns (of long or array<long>) are kept; if there are any, the id is theirs.
    """
    names = ["id", "word", "n", "nodes", *carried[1:]]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), *(pa.list_(pa.int64()) for _ in carried[1:])]

    def number(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        row, free, last, nodes = base, base + 1, "", [base]
        for batch in batches:
            made = []
            for word in batch.column(0).to_pylist():
                same = len(commonprefix((last, word)))
                nodes = nodes[: same + 1] + list(range(free, free + len(word) - same))
                free += len(word) - same
                made.append(nodes)
                last = word
            ids = batch.column(2) if carried else pa.array(range(row, row + len(made)), pa.int64())
            row += len(made)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(0), batch.column(1), pa.array(made, kinds[3]), *batch.columns[3:]], schema=pa.schema(list(zip(names, kinds)))
            )

    schema = NUMBERED + "".join(f", {c} array<long>" for c in carried[1:])
    ordered = words.select("word", "n", *carried).repartitionByRange("word").sortWithinPartitions("word")
    table = stored(ordered.mapInArrow(number, schema), "trie-numbers")
    return table, _aliases(table)


def _aliases(table):
    """Numbers of nodes that an earlier range has numbered already, with its number.

    The driver sees the first and the last word of every task, so this grows with the number of partitions alone.
    """
    part = F.shiftright(F.element_at("nodes", -1), 40)
    borders = table.groupBy(part.alias("part")).agg(
        F.min("word").alias("first"), F.min_by("nodes", "word").alias("opens"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("closes")
    )
    alias, last, known = {}, None, []
    for b in sorted(borders.collect(), key=lambda b: b["first"]):
        if last is not None:
            same = len(commonprefix((last, b["first"])))
            alias.update(zip(b["opens"][: same + 1], known))
        last, known = b["last"], [alias.get(node, node) for node in b["closes"]]
    return alias


def _renamed(nodes, alias):
    """The canonical numbers; aliased ones are few, so most batches hold none."""
    if alias:
        old = np.array(sorted(alias))
        at = np.searchsorted(old, nodes)
        hit = (at < len(old)) & (old[np.minimum(at, len(old) - 1)] == nodes)
        nodes[hit] = np.array([alias[o] for o in old])[at[hit]]
    return nodes


#: Kinds of a pair's rows: nothing skipped, a letter skipped, a letter skipped that repeats the one before it.
WHOLE, SKIPPED, REPEATED = 0, 1, 2


def pairs(words):
    """(p, s, id, n, kind): the node pairs of every word of `words(word, n)`, and the words with their ids.

    Of a run of equal letters, skipping any gives the same string; only the first (SKIPPED) stands for a deletion.
    """
    forward, forward_alias = _numbered(words)
    turned = forward.select(F.reverse("word").alias("word"), "n", "id", F.col("nodes").alias("prefixes"))
    both, backward_alias = _numbered(turned, ("id", "prefixes"))

    def emit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, counts = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                turned = part.column(2).to_pylist()
                prefix, suffix = (_renamed(part.column(i).flatten().to_numpy(zero_copy_only=False).copy(), a) for i, a in ((3, forward_alias), (4, backward_alias)))
                letters = np.frombuffer("".join(w[::-1] for w in turned).encode("utf-32-le"), "<u4")
                sizes = np.array([len(w) for w in turned])
                # node k of a word of m letters lies at its start + k; the suffix from letter i on has m - i letters
                starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
                owner = np.repeat(np.arange(len(sizes)), sizes + 1)
                i = np.arange(len(owner)) - starts[owner]
                p, s = prefix[starts[owner] + i], suffix[starts[owner] + sizes[owner] - i]
                inner = i < sizes[owner]  # all but the end: a letter follows that can be skipped
                skip_p, skip_s = p[inner], s[np.flatnonzero(inner) + 1]
                repeats = np.concatenate(([False], letters[1:] == letters[:-1])) & (i[inner] > 0)
                kind = np.concatenate((np.full(len(p), WHOLE), np.where(repeats, REPEATED, SKIPPED)))
                of = np.concatenate((owner, owner[inner]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((p, skip_p))), pa.array(np.concatenate((s, skip_s))), pa.array(ids[of]), pa.array(counts[of]), pa.array(kind.astype("i4"))],
                    names=["p", "s", "id", "n", "kind"],
                )

    rows = both.select("id", "n", "word", "prefixes", "nodes").mapInArrow(emit, "p long, s long, id long, n long, kind int")
    return rows, forward.select("id", "word", "n")


def _met(p, s, ids, n, kind):
    """Of whole groups of rows in order of (p, s): per row with neighbours its id, their number, the best one's n and id."""
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])))
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    if not several.any():
        return None
    ids, n, kind = ids[several], n[several], kind[several]
    group = np.unique(group[several], return_inverse=True)[1]
    # skipped letters first, then the best (n, then word order); the whole word, if any, is the group's last row
    order = np.lexsort((ids, -n, kind == WHOLE, group))
    ids, n, kind, group = ids[order], n[order], kind[order], group[order]
    size = np.bincount(group)
    top = np.concatenate(([0], np.cumsum(size)))[:-1]
    bottom = top + size - 1
    has_whole = kind[bottom] == WHOLE
    n_skipped = size - has_whole
    deletes = kind == SKIPPED
    n_deletes = np.bincount(group, weights=deletes).astype("i8")
    row, none = np.arange(len(ids)), len(ids)
    best_delete = np.minimum.reduceat(np.where(deletes, row, none), top)
    of = group
    other = np.where(row == top[of], top[of] + 1, top[of])
    other = np.where(n_skipped[of] > 1, other, none)
    ids_, n_ = np.append(ids, 2**62), np.append(n, -1)
    whole = bottom[of]
    better = deletes & has_whole[of] & ((n_[whole] > n_[other]) | (n_[whole] == n_[other]) & (ids_[whole] < ids_[other]))
    is_whole = kind == WHOLE
    near = np.where(is_whole, n_deletes[of], n_skipped[of] - 1 + (deletes & has_whole[of]))
    best = np.where(is_whole, best_delete[of], np.where(better, whole, other))
    met = near > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[met]), pa.array(near[met]), pa.array(n_[best[met]]), pa.array(ids_[best[met]])], names=["id", "near", "best_n", "best"]
    )


def neighbours(rows):
    """(id, n_near, best_n, best) of the words that have any near word; the best is the most frequent, ties by word order."""

    def meet(batches):
        kept = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            if kept is not None:
                columns = [np.concatenate(c) for c in zip(kept, columns)]
            # the last group may go on in the next batch; it has at most as many rows as there are letters
            p, s = columns[0], columns[1]
            first = np.flatnonzero((p != p[-1]) | (s != s[-1]))
            cut = first[-1] + 1 if len(first) else 0
            kept = [c[cut:] for c in columns]
            if cut and (made := _met(*(c[:cut] for c in columns))) is not None:
                yield made
        if kept is not None and (made := _met(*kept)) is not None:
            yield made

    ordered = rows.repartition("p", "s").sortWithinPartitions("p", "s").select("p", "s", "id", "n", "kind")
    met = ordered.mapInArrow(meet, "id long, near long, best_n long, best long")
    best = F.max(F.struct("best_n", (-F.col("best")).alias("minus")))
    return met.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("b")).select("id", "n_near", F.col("b.best_n").alias("best_n"), (-F.col("b.minus")).alias("best"))


def _roots(forms):
    """(id, root) of (id, form): forms are followed to their end, twice as far each round."""
    state = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if not state.join(ahead, "root", "left_semi").take(1):
            return state
        state = stored(state.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")


def variants(words, times=10):
    """Spelling variants of `words(word, n)`, whose words are distinct: a row per word.

    form: the most frequent near word (ties: the first in code-point order) if it is `times` as frequent, form_n its n;
    root: where the forms lead, the word itself without a form; n_near: the number of near words.  Forms grow by
    `times` each step, so they lead nowhere in a circle.
    """
    rows, named = pairs(words)
    near = stored(neighbours(rows), "near-words")
    forms = stored(near.join(named.select("id", "n"), "id").filter(F.col("best_n") >= times * F.col("n")).select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n")), "forms")
    of_form, of_root = (named.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word")) for c in ("form", "root"))
    led = forms.join(_roots(forms), "id").join(of_form, "form").join(of_root, "root").select("id", "form_word", "root_word", "form_n")
    return (
        named.join(near.select("id", "n_near"), "id", "left").join(led, "id", "left")
        .select(
            "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
        )
    )
