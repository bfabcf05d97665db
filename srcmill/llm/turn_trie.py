"""Prefix trie of conversations by vertical bitmaps.

Conversations, in order of their ids, are cut into shards of bounded size.  A shard indexes (position, turn) to the
bitset of its conversations and walks its part of the trie depth first: a child is the intersection of its parent's
bitset with a posting, its popcount the number of members, the members that end there its end list.  Nodes of shards
are the same node where their paths are the same; counts add up over shards, and of a shared node's copies the first
shard's one owns it, so that sums over distinct nodes add up, too.  No group holds more rows than there are shards.

A path is known by 128 bits of a SHA-256 over its turns.  Rows without a conv_id take no part; a null role or text is
empty; turns of a conversation are ordered by turn (nulls first), equal ones by their hash, repeated rows are repeated
turns.  Other columns are ignored, whatever their names.  No conversations give no nodes, not even a root.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from .tables import TOKEN, stored

#: A shard ends with the conversation that reaches one of these numbers.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 1 << 16

EMPTY = hashlib.sha256(b"").hexdigest()
NODES = (
    "shard long, pre long, stop long, up long, depth long, path binary, words long, n long, first long, n_ends long, ends string, ends_sha256 string"
)


def turn_rows(table):
    """(conv_id, turn, key, words) a row: the turn's hash and the number of words of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length before the role keeps (role, text) apart from any other pair
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return table.filter("conv_id is not null").select(
        "conv_id", "turn", F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("key"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("words")
    )


def placed(turns):
    """Turns with their position from 1 on; each conversation also has a row of position 0 without a turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    rows = turns.select("conv_id", F.row_number().over(order).cast("long").alias("position"), "key", "words")
    # the first turn's row opens its conversation
    root = F.struct(F.lit(0).cast("long").alias("position"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    own = F.struct("position", "key", "words")
    return rows.select("conv_id", F.explode(F.when(F.col("position") == 1, F.array(root, own)).otherwise(F.array(own))).alias("t")).select("conv_id", "t.*")


def rebuilt(rows, family=20, heads=4):
    """Placed turns in which conversation c begins with the first h turns of c - c % family, h = crc32(c) % heads.

    Its own first h turns go; those after them follow.  Positions keep the order, not the number.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % family
    rows = rows.withColumn("h", head).withColumn("base", base)
    own = rows.filter("conv_id = base or position = 0 or position > h")
    # a family has at most `family` conversations, and a head fewer than `heads` turns
    wanted = rows.filter("position = 0 and h > 0 and conv_id <> base").select("conv_id", "h", "base")
    given = rows.filter((F.col("conv_id") == F.col("base")) & F.col("position").between(1, heads - 1)).select("base", "position", "key", "words")
    return own.select("conv_id", "position", "key", "words").unionByName(
        wanted.join(given, "base").filter("position <= h").select("conv_id", "position", "key", "words")
    )


class _Shard:
    """The conversations of a shard: the turns of each, as ids of (position, turn), and the postings of these."""

    def __init__(self):
        self.ids, self.turns, self.words, self.keys = [], [], [], []
        self.posting, self.number, self.size = [], {}, 0

    def start(self, conv_id):
        self.ids.append(conv_id)
        self.turns.append([])

    def add(self, key, words):
        place = (len(self.turns[-1]), key)
        at = self.number.setdefault(place, len(self.keys))
        if at == len(self.keys):
            self.keys.append(key)
            self.words.append(words)
            self.posting.append(0)
        self.posting[at] |= 1 << (len(self.ids) - 1)
        self.turns[-1].append(at)
        self.size += 1

    def full(self):
        return len(self.ids) >= SHARD_CONVERSATIONS or self.size >= SHARD_TURNS

    def nodes(self, shard):
        """The nodes in preorder: `stop` is where a node's subtree ends, `up` where its parent is."""
        rows, stop = [], []
        # (members, posting of the last turn, depth, parent, path of the parent); a None closes a node
        todo = [((1 << len(self.ids)) - 1, None, 0, None, b"")]
        while todo:
            members, at, depth, up, path = todo.pop()
            if members is None:
                stop[up] = len(rows)
                continue
            pre = len(rows)
            path = hashlib.sha256(path + self.keys[at]).digest()[:16] if depth else b""
            first = (members & -members).bit_length() - 1
            todo.append((None, None, 0, pre, b""))
            ends, children = [], []
            left, count = members, members.bit_count()
            while left:
                i = (left & -left).bit_length() - 1
                turns = self.turns[i]
                if len(turns) == depth:
                    ends.append(self.ids[i])
                    left ^= 1 << i
                else:
                    child = left & self.posting[turns[depth]]
                    children.append((child, turns[depth], depth + 1, pre, path))
                    left ^= child
            listed = ",".join(map(str, ends))
            rows.append((
                shard, pre, 0, -1 if up is None else up, depth, path, self.words[at] if depth else 0, count, self.ids[first],
                len(ends), listed or None, hashlib.sha256(listed.encode()).hexdigest() if ends else None,
            ))
            stop.append(0)
            todo.extend(reversed(children))
        for i, r in enumerate(rows):
            rows[i] = (*r[:2], stop[i], *r[3:])
        return rows


def shard_nodes(rows):
    """The nodes of every shard's own trie.  `first` is the smallest member, `n` the number of members."""
    kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * 4 + [pa.string()] * 2
    names = [c.split()[0] for c in NODES.split(", ")]

    def index(batches):
        from pyspark import TaskContext

        part, count, shard = TaskContext.get().partitionId(), 0, _Shard()

        def batches_of(shard, number):
            made = shard.nodes(number)
            for i in range(0, len(made), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[i : i + 20_000]), kinds)], names=names)

        for batch in batches:
            for conv_id, position, key, words in zip(*(c.to_pylist() for c in batch.columns)):
                if position:
                    shard.add(key, words)
                    continue
                if shard.full():
                    yield from batches_of(shard, part << 32 | count)  # numbers of shards rise with the ids in them
                    shard, count = _Shard(), count + 1
                shard.start(conv_id)
        if shard.ids:
            yield from batches_of(shard, part << 32 | count)

    ordered = rows.select("conv_id", "position", "key", "words").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(index, NODES)


def _subtree_sums(nodes):
    """Per shard node: the shard's share of the sums over its subtree, and its parent's conv_id."""
    schema = "path binary, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
    columns = ["shard", "pre", "stop", "up", "path", "conv_id", "own", "leaf", "words", "n"]

    def sums(batches):
        shard, held = None, []

        def made(held):
            whole = pa.concat_batches(held)
            stop, up, conv_id, own, leaf, words, n = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("stop", "up", "conv_id", "own", "leaf", "words", "n"))
            pre = np.arange(len(stop))

            def below(values):
                total = np.concatenate(([0], np.cumsum(values)))
                return total[stop] - total[pre]

            inner = up >= 0
            return pa.RecordBatch.from_arrays(
                [
                    whole.column("path"), pa.array(conv_id[np.maximum(up, 0)], pa.int64(), mask=~inner),
                    pa.array(np.bincount(up[inner], weights=own[inner], minlength=len(up)).astype("i8")),
                    pa.array(below(own * leaf)), pa.array(below(words * (n - own))),
                ],
                names=["path", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"],
            )

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and shard != numbers[a]:
                    yield made(held)
                    held = []
                shard = numbers[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield made(held)

    return nodes.select(*columns).repartition("shard").sortWithinPartitions("shard", "pre").mapInArrow(sums, schema)


def _joined_ends(nodes):
    """path, ends_sha256 of nodes whose end lists lie in several shards: each list is hashed in order, piece by piece.

    A digest reads its list in one pass, so one task passes over the pieces of a node; it holds one at a time.
    """

    def hashed(batches):
        path, state = None, None
        for batch in batches:
            done = []
            for p, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != path:
                    if state:
                        done.append((path, state.hexdigest()))
                    path, state = p, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], names=["path", "ends_sha256"])

    ordered = nodes.filter("ends is not null and ending_shards > 1").select("path", "shard", "ends").repartition("path").sortWithinPartitions("path", "shard")
    return ordered.select("path", "ends").mapInArrow(hashed, "path binary, ends_sha256 string")


def trie(rows):
    """The nodes of the trie of placed turns, a row each; see `op13_conversation_trie` for the columns."""
    local = stored(shard_nodes(rows), "trie-shards")
    everywhere = Window.partitionBy("path")
    merged = stored(
        local.select(
            "shard", "pre", "stop", "up", "depth", "path", "words", "n",
            F.min("first").over(everywhere).alias("conv_id"), F.sum("n").over(everywhere).alias("n_convs"),
            (F.col("shard") == F.min("shard").over(everywhere)).cast("long").alias("own"),
            (F.sum("n_ends").over(everywhere) == F.sum("n").over(everywhere)).cast("long").alias("leaf"),
            F.count("*").over(everywhere).alias("shards"), F.count("ends_sha256").over(everywhere).alias("ending_shards"),
            F.max("ends_sha256").over(everywhere).alias("ends_sha256"),
        ),
        "trie-nodes",
    )
    sums = _subtree_sums(merged)
    added = sums.groupBy("path").agg(F.max("parent_conv_id").alias("parent_conv_id"), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    several = merged.filter("ending_shards > 1 and own = 1").select("path", "ending_shards")
    joined = _joined_ends(local.join(several, "path"))
    return (
        merged.filter("own = 1").select("path", "conv_id", "depth", "n_convs", "ending_shards", "ends_sha256")
        .join(added, "path")
        .join(joined.withColumnRenamed("ends_sha256", "joined"), "path", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("joined", "ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        )
    )


def conversation_trie(table, family=20, heads=4):
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    rows = stored(placed(turn_rows(table)), "trie-turns")
    return trie(rebuilt(rows, family, heads))
