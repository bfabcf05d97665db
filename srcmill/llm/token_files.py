"""Token ids of documents as flat files of unsigned integers, with 64-bit offsets.

A data set is a folder: `ids/<part>.bin` holds the ids of the part's documents one after the other, `<part>.docs` their
doc_ids (int64), `<part>.idx` for each document and the end the number of ids before it in the whole data set
(uint64), and `manifest` the parts.  All numbers are little-endian; ids are uint16 where the vocabulary allows it.
"""

import functools
import json
import re
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Window, functions as F

from .tables import trimmed

MANIFEST = "part int, name string, width int, n_docs long, n_ids long"
#: doc_id of a document whose id is null.
NO_ID = -(2**63)
#: Pieces whose ids a task remembers before it starts anew.
REMEMBERED = 300_000
#: Bytes of text whose pieces are numbered at once.
SLICE = 4 << 20

# How the tokenizer files with word ends normalise and split a text; below, the same for texts of
# Latin letters, so that ids can be remembered by piece.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]


def _class(kind):
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")
#: Control and space characters on which libraries differ, and whatever lies beyond the Latin letters.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]|<\|")

#: Kinds of the characters of a text without OTHER, by code point.
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
KINDS = np.array([_SPACE if chr(c).isspace() else {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(c))[0], _MARK) for c in range(0x180)], np.uint8)

#: A byte as the letter that stands for it in byte-level vocabularies: itself if it is printable, else one from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def cut(texts):
    """What PIECES finds in lower-case texts without OTHER: all pieces, and for each text and the end the pieces before it.

    Neighbours of one kind are one piece, a digit is one by itself; an apostrophe that starts a piece takes s, t, m, d,
    re, ve or ll along.
    """
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KINDS[data]
    wide = np.flatnonzero(data >= 0x80)[::2]  # without OTHER a character has two bytes at most
    kind[wide] = kind[wide + 1] = KINDS[(data[wide] & 0x1F).astype(int) << 6 | data[wide + 1] & 0x3F]
    first = kind == _DIGIT
    first[1:] |= kind[1:] != kind[:-1]
    first[wide + 1] = False
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    mark = np.flatnonzero((data == ord("'")) & first)
    room = offsets[np.searchsorted(offsets, mark, "right")] - mark
    a, b = (np.where(room > n, data[np.minimum(mark + n, len(data) - 1)], 0) for n in (1, 2))
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    first[mark[one | two] + 1] = False
    after = np.concatenate((mark[one] + 2, mark[two] + 3))
    first[after[after < len(data)]] = True
    kept = kind != _SPACE
    first &= kept
    starts = np.append(np.flatnonzero(first[kept]), np.count_nonzero(kept))
    pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data[kept]))
    return pieces, np.searchsorted(np.flatnonzero(first), offsets)


@functools.lru_cache(1)
def _library(path):
    """The tokenizer of a file, and whether its pieces are those of PIECES; a worker reads it once, not once a task."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    spec = json.loads(library.to_str())
    steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [s.get("pattern", {}).get("Regex") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    kinds = [s["type"] for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return library, steps == NORMAL and splits[:1] == [SPLIT] and kinds == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE"


class Encoder:
    """Encodes texts with the tokenizers library; the ids of a piece are remembered where pieces are independent.

    There the pieces of a slice of texts are numbered, each different one is looked up once, and ids are gathered by number.
    """

    def __init__(self, path, end_id):
        self.library, self.by_piece = _library(path)
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.known = {}

    def _plain(self, texts):
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces):
        """Ids of pieces, by the library's model alone: a piece needs no more normalising and splitting."""
        tokenize, code = self.library.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
        # printable ASCII letters stand for themselves
        return [array(code, [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(LETTERS))]).tobytes() for p in pieces]

    def _known(self, pieces):
        """The ids of each of different pieces."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self._pieces(new)))
        return list(map(self.known.__getitem__, pieces))

    def _slice(self, texts):
        """The ids of each of some texts that hold none of OTHER."""
        pieces, borders = cut(pc.utf8_lower(texts))
        numbered = pieces.dictionary_encode()
        ids = pa.array(self._known(numbered.dictionary.to_pylist()), pa.large_binary()).take(numbered.indices)
        _, starts, data = ids.buffers()
        edges = np.frombuffer(starts, np.int64)[borders].tolist()
        data = memoryview(data or b"")
        return [data[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def encode(self, texts):
        """The ids of each text (a list or an Arrow array), with the end id, as bytes."""
        texts = pa.array(texts, pa.large_utf8()) if isinstance(texts, list) else texts.cast(pa.large_utf8())
        other = pc.match_substring_regex(texts, OTHER.pattern).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(texts), bool)
        out = [None] * len(texts)
        whole, rest = np.flatnonzero(other), np.flatnonzero(~other)
        for i, ids in zip(whole.tolist(), self._plain(texts.take(pa.array(whole)).to_pylist())):
            out[i] = ids
        # as many texts at once as fill a slice
        ends = np.cumsum(pc.binary_length(texts).to_numpy()[rest])
        for rows in np.split(rest, np.flatnonzero(np.diff(ends // SLICE)) + 1):
            for i, ids in zip(rows.tolist(), self._slice(texts.take(pa.array(rows)))):
                out[i] = ids
        return [ids + self.end for ids in out]


def _files(path):
    """File system and place of a folder; the scheme may be missing."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def write(docs, path, tokenizer, end_id, doc_id="doc_id", text="text"):
    """Write the documents in ascending doc_id order (nulls first, ties by the text's hash); returns the manifest.

    A null text is empty: it gets the end id alone.  Documents are range-partitioned, so a part is a range of ids and
    any number of tasks can write at once.  A task writes files of its own name and reports them in the manifest; files
    of failed attempts are in no manifest.  Bases of parts are prefix sums over the manifest.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    )

    def write_part(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        store, top = _files(path)
        store.create_dir(f"{top}/ids", recursive=True)
        encoder = Encoder(tokenizer, end_id)
        lengths, n = [], 0
        with store.open_output_stream(f"{top}/ids/{name}.bin") as ids, store.open_output_stream(f"{top}/ids/{name}.docs") as names:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    piece = batch.slice(at, 2048)
                    made = encoder.encode(piece.column("text"))
                    for x in made:
                        ids.write(x)
                    lengths.append(np.array([len(x) // encoder.kind.itemsize for x in made], "<i8"))
                    names.write(piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n += batch.num_rows
        if not n:
            for end in ("bin", "docs"):
                store.delete_file(f"{top}/ids/{name}.{end}")
            return
        lengths = np.concatenate(lengths)
        with store.open_output_stream(f"{top}/ids/{name}.len") as out:
            out.write(lengths.tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "name": [name], "width": pa.array([encoder.kind.itemsize], pa.int32()), "n_docs": [n], "n_ids": [int(lengths.sum())]}
        )

    ordered.select("doc_id", "text").mapInArrow(trimmed(write_part), MANIFEST).write.parquet(f"{path}/parts")
    parts = spark.read.schema(MANIFEST).parquet(f"{path}/parts")
    # one row per part: prefix sums over the parts need no spreading
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def write_offsets(batches):
        store, top = _files(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{top}/ids/{row['name']}.len") as f:
                    lengths = np.frombuffer(f.read(), "<i8")
                starts = np.concatenate(([0], np.cumsum(lengths))) + row["base"]
                with store.open_output_stream(f"{top}/ids/{row['name']}.idx") as out:
                    out.write(starts.astype("<u8").tobytes())
            yield batch

    based.repartition(max(1, parts.count())).mapInArrow(write_offsets, f"{MANIFEST}, base long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _mapped(store, place, kind):
    """A file's numbers: memory-mapped if it is local, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(place, kind, "r") if store.get_file_info(place).size else np.empty(0, kind)
    with store.open_input_file(place) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read(spark, path):
    """Per document of a data set, from its files: doc_id, start, n_tokens, ids_crc32 (of its ids as uint32).

    An empty data set gives no rows.
    """
    manifest = spark.read.schema(f"{MANIFEST}, base long").parquet(f"{path}/manifest")

    def documents(batches):
        store, top = _files(path)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{top}/ids/{row['name']}"
                ids = _mapped(store, f"{at}.bin", f"<u{row['width']}")
                names, starts = _mapped(store, f"{at}.docs", "<i8"), _mapped(store, f"{at}.idx", "<u8").astype(np.int64)
                for i in range(0, row["n_docs"], 5000):
                    edges = starts[i : i + 5001]
                    some = ids[edges[0] - row["base"] : edges[-1] - row["base"]].astype("<u4")
                    local = edges - edges[0]
                    crc = [zlib.crc32(some[a:b]) for a, b in zip(local[:-1].tolist(), local[1:].tolist())]
                    own = np.array(names[i : i + 5000])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, pa.int64(), mask=own == NO_ID),
                        "start": pa.array(edges[:-1], pa.int64()), "n_tokens": pa.array(np.diff(edges), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    return manifest.repartition(max(1, manifest.count())).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
