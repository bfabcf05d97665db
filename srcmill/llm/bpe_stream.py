"""BPE encoding by a streaming transducer of bounded lookahead, and decoding by a byte-to-text state machine.

A merge list whose rules are built from earlier ones fixes how far a change at the end of a string can reach back.  Once
that many symbols were read behind a token, no continuation can change it, so it is emitted and forgotten: what is held
of a text is a bounded window, however long the text or one of its pieces is.

Null texts are empty and have no tokens.  Rows are mapped one by one: repeated rows, ties and null doc_ids stay as they
are, no rows give no rows.
"""

import codecs
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from .token_files import LETTERS, NORMAL, OTHER, PIECES, SPLIT

#: Characters that are normalised and split at once, if a text has a place where it can be cut.
CHUNK = 1 << 16
#: Pieces up to this length are remembered with their ids; up to so many bytes of them.
SHORT, REMEMBERED = 48, 96 << 20

_LETTER = [chr(LETTERS.get(b, b)) for b in range(256)]
_BYTE = {ord(c): b for b, c in enumerate(_LETTER)}


class Merges:
    """The merge list of a tokenizers file."""

    def __init__(self, spec):
        model = spec["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"no plain BPE merge list: {model['type']} {odd}")
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = [vocab.get(c) for c in _LETTER]
        self.last = [vocab.get(c + self.end) for c in _LETTER]
        self.vocab = vocab
        self.rule, self.parts, self.length = {}, {}, {}
        self.proper = True
        for i in {*self.inner, *self.last} - {None}:
            self.length[i] = 1
        for rank, rule in enumerate(model["merges"]):
            left, right = (vocab[x] for x in (rule.split(" ") if isinstance(rule, str) else rule))
            made = vocab[rule.replace(" ", "") if isinstance(rule, str) else "".join(rule)]
            self.rule.setdefault(left << 32 | right, (rank, made))
            # a token must come from one rule, made of symbols or of tokens of earlier rules
            self.proper &= left in self.length and right in self.length and made not in self.length
            self.length.setdefault(made, self.length.get(left, 1) + self.length.get(right, 1))
            self.parts.setdefault(made, (left, right))
        self.lookahead = self._lookahead() if self.proper else None

    def _lookahead(self):
        """Symbols before its end that a string's continuation can still re-tokenise.

        A rule (u, v) that applies across the border up to which two continuations agree moves the border back by u.
        The next rule that does so is a later one, and its right side starts with u, since u has been formed there.  The
        heaviest chain of such rules, by the lengths of their u, is the bound.
        """
        heaviest = {}  # by u: the heaviest chain so far that ends in a rule (u, ...)
        for key in self.rule:  # in order of rank
            left, right = key >> 32, key & 0xFFFFFFFF
            chain, at = 0, right
            while at is not None:
                chain = max(chain, heaviest.get(at, 0))
                at = self.parts[at][0] if at in self.parts else None
            heaviest[left] = max(heaviest.get(left, 0), chain + self.length[left])
        return max(heaviest.values(), default=0)

    def merged(self, ids):
        """The tokens of a string of symbols: the rule of lowest rank first, from the left."""
        return self._few(ids) if len(ids) <= 24 else self._many(ids)

    def _few(self, ids):
        ids, rule = list(ids), self.rule.get
        found = [rule(a << 32 | b) for a, b in zip(ids, ids[1:])]
        while True:
            best = None
            for i, f in enumerate(found):
                if f is not None and (best is None or f[0] < best):
                    best, at = f[0], i
            if best is None:
                return ids
            ids[at : at + 2] = [found[at][1]]
            del found[at]
            if at < len(found):
                found[at] = rule(ids[at] << 32 | ids[at + 1])
            if at:
                found[at - 1] = rule(ids[at - 1] << 32 | ids[at])

    def _many(self, ids):
        ids, rule, n = list(ids), self.rule.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(f[0], i, f[1]) for i in range(n - 1) if (f := rule(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            rank, i, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] is None or j == n or rule(ids[i] << 32 | ids[j], (None,))[0] != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = made, None, after[j]
            if after[j] < n:
                before[after[j]] = i
                if f := rule(made << 32 | ids[after[j]]):
                    heapq.heappush(queue, (f[0], i, f[1]))
            if (k := before[i]) >= 0 and (f := rule(ids[k] << 32 | made)):
                heapq.heappush(queue, (f[0], k, f[1]))
        return [i for i in ids if i is not None]


class PieceTransducer:
    """Tokens of one piece whose bytes arrive in any portions; at most a few lookaheads of symbols are held."""

    def __init__(self, merges):
        self.merges, self.held, self.final = merges, [], b""
        self.room = None if merges.lookahead is None else 4 * merges.lookahead + 256

    def feed(self, portion):
        """The tokens that have become stable.  The last byte waits, as it may end the piece."""
        out, portion = [], self.final + portion
        portion, self.final = portion[:-1], portion[-1:]
        step = self.room or max(1, len(portion))
        for i in range(0, len(portion), step):
            self.held += [self.merges.inner[b] for b in portion[i : i + step]]
            if self.room and len(self.held) > self.room:
                out += self._stable(len(self.held) - self.merges.lookahead)
        return out

    def _stable(self, safe):
        tokens, end, n = self.merges.merged(self.held), 0, 0
        for token in tokens:
            if end + self.merges.length[token] > safe:
                break
            end, n = end + self.merges.length[token], n + 1
        del self.held[:end]
        return tokens[:n]

    def close(self):
        """The remaining tokens."""
        return self.merges.merged(self.held + [self.merges.last[b] for b in self.final])


class Encoder:
    """Ids of texts as the tokenizers library gives them; normalising and splitting unusual characters are left to it.

    `feed` takes a text in any portions and returns the ids that have become stable, `close` ends the text.  Ids are
    bytes of little-endian unsigned 32-bit integers.  Portions are cut before an ASCII letter or digit behind white
    space, or within a long run of ASCII letters; only a text without such a place is held until its end.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spec = json.loads(self.library.to_str())
        self.merges = Merges(self.spec)
        added = self.spec.get("added_tokens") or []
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that depend on what is around them")
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        steps = [s["type"] for s in (self.spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (self.spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_piece = steps == NORMAL and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == SPLIT
        within = max(3, *map(len, self.added), 3)
        self.cut = re.compile(rf"(?s:.*)(?:(?<=[ \t\n])(?=[0-9A-Za-z])|(?<=[A-Za-z]{{{within}}})(?=[A-Za-z]))")
        self.known, self.size = {}, 0
        self._start()

    def _start(self):
        self.pending, self.open = "", None

    def feed(self, text):
        out = []
        for i in range(0, len(text), CHUNK):
            self.pending += text[i : i + CHUNK]
            if self.by_piece and len(self.pending) >= CHUNK and (place := self.cut.match(self.pending)):
                head, self.pending = self.pending[: place.end()], self.pending[place.end() :]
                out.append(self._ids(head, goes_on=head[-1].isalpha()))
        return b"".join(out)

    def close(self):
        out = self._ids(self.pending, goes_on=False)
        self._start()
        return out

    def encode(self, text):
        """All ids of a text."""
        return self.feed(text) + self.close()

    def _ids(self, text, goes_on):
        """Ids of the next part of a text; its last piece may go on in the part after it."""
        if self.by_piece and not OTHER.search(text):
            pieces = PIECES.findall(text.lower())
            if not (goes_on or self.open) and self._learned(pieces):
                return b"".join(map(self.known.__getitem__, pieces))
            return b"".join(self._pieces(pieces, goes_on, str.encode))
        out, parts, at = [], [m for m in self.special.finditer(text)], 0
        for m in parts:
            out += [*self._library_pieces(text[at : m.start()], False), _ids([self.added[m[0]]])]
            at = m.end()
        return b"".join(out + self._library_pieces(text[at:], goes_on))

    def _learned(self, pieces):
        """Remember the ids of all pieces, unless one of them is long."""
        different = set(pieces)
        new = [p for p in different if p not in self.known]
        if any(len(p) > SHORT for p in new):
            return False
        if self.size > REMEMBERED:
            self.known, self.size, new = {}, 0, different
        for piece in new:
            self.known[piece] = self._short(piece.encode())
            self.size += 200 + len(piece)  # two objects and their place
        return True

    def _short(self, piece):
        inner = self.merges.inner
        return _ids(self.merges.merged([inner[b] for b in piece[:-1]] + [self.merges.last[piece[-1]]]))

    def _library_pieces(self, text, goes_on):
        if not text:
            return self._pieces([], False, None)
        normal, split = self.library.normalizer, self.library.pre_tokenizer
        text = normal.normalize_str(text) if normal else text
        pieces = [p for p, _ in split.pre_tokenize_str(text)] if split else [text]
        return self._pieces(pieces, goes_on, lambda p: bytes(map(_BYTE.__getitem__, map(ord, p))))

    def _pieces(self, pieces, goes_on, as_bytes):
        out = []
        if self.open and not (pieces and pieces[0][:1].isalpha()):
            raise AssertionError("a piece was cut where it doesn't go on")
        for i, piece in enumerate(pieces):
            more = goes_on and i == len(pieces) - 1
            if self.open or more or len(piece) > SHORT:
                self.open = self.open or PieceTransducer(self.merges)
                out.append(_ids(self.open.feed(as_bytes(piece))))
                if not more:
                    out.append(_ids(self.open.close()))
                    self.open = None
            else:
                out.append(self._short(as_bytes(piece)))
        return out


def _ids(tokens):
    return np.array(tokens, "<u4").tobytes()


class Decoder:
    """Text of ids that arrive in any portions, as the library's decode without skipping special tokens.

    A byte-level decoder turns tokens into bytes, and a UTF-8 state machine holds at most three of them until a
    character is whole; broken ones become U+FFFD.  A file that names no decoder has its tokens listed, a space between.
    `plain=True` reads those as text, too: letters back to bytes, word ends as spaces.  Unknown ids give nothing.
    """

    def __init__(self, spec, plain=False):
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no such decoder: {kind}")
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens") or []}
        end = spec["model"].get("end_of_word_suffix") or ""
        self.listed = kind is None and not plain
        as_bytes = str.encode if self.listed else lambda t: _token_bytes(t, end if plain else "")
        top = max(names, default=-1) + 1
        self.table = [as_bytes(names[i]) if i in names else None for i in range(top)]
        self._start()

    def _start(self):
        self.machine, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids):
        """The text that is certain now; ids as bytes of little-endian unsigned 32-bit integers."""
        numbers = np.frombuffer(ids, "<u4")
        tokens = [t for t in map(self.table.__getitem__, numbers[numbers < len(self.table)].tolist()) if t is not None]
        if not tokens:
            return ""
        if not self.listed:
            return self.machine.decode(b"".join(tokens))
        lead, self.first = b"" if self.first else b" ", False
        return self.machine.decode(lead + b" ".join(tokens))

    def close(self):
        out = self.machine.decode(b"", final=True)
        self._start()
        return out


def _token_bytes(token, end):
    word_end = bool(end) and token.endswith(end)
    letters = token[: len(token) - len(end)] if word_end else token
    if any(ord(c) not in _BYTE for c in letters):
        return token.encode()
    return bytes(_BYTE[ord(c)] for c in letters) + b" " * word_end


def map_texts(docs, make, result, keep=("doc_id",), text="text"):
    """A row per document: the kept columns and those that make() computes from a text, a column a field of `result`.

    `make()` is called once a task and returns a function from a text to a tuple.
    """
    fields = [f"`{c}`" for c in keep]
    schema = docs.select(*fields).schema
    for name, kind in result.items():
        schema = schema.add(name, KINDS[kind][0])

    def rows(batches):
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = zip(*(one(t) for t in part.column(part.num_columns - 1).to_pylist()))
                columns = [*part.columns[:-1], *(pa.array(c, KINDS[k][1]) for c, k in zip(made, result.values()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.select(*fields, F.coalesce(F.col(text), F.lit("")).alias("whole text")).mapInArrow(rows, schema)


KINDS = {
    "long": (T.LongType(), pa.int64()), "string": (T.StringType(), pa.string()), "array<int>": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
}


def encoded(docs, tokenizer, **names):
    """Documents as ids: doc_id, ids array<int>."""

    def make():
        encoder = Encoder(tokenizer)
        return lambda text: (np.frombuffer(encoder.encode(text), "<u4").astype("<i4"),)

    return map_texts(docs, make, {"ids": "array<int>"}, **names)


def digests(docs, tokenizer, **names):
    """Per document: doc_id, n_tokens, ids_sha256 of its ids (uint32) and decoded_sha256 of the text they decode to.

    A text passes through encoder, hash and decoder in chunks; neither its ids nor its decoded text is ever whole.
    """

    def make():
        encoder = Encoder(tokenizer)
        decoder = Decoder(encoder.spec)

        def digest(text):
            ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
            for i in range(0, len(text) + CHUNK, CHUNK):
                ids = encoder.feed(text[i : i + CHUNK]) if i < len(text) else encoder.close()
                ids_hash.update(ids)
                text_hash.update(decoder.feed(ids).encode())
                n += len(ids) // 4
            text_hash.update(decoder.close().encode())
            return n, ids_hash.hexdigest(), text_hash.hexdigest()

        return digest

    return map_texts(docs, make, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, **names)
