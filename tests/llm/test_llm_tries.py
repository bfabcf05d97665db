"""Spelling variants, streaming BPE and the conversation trie against plain forms, with the odd cases of each."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from srcmill.llm import bpe_stream, queries, spelling, toxicity, turn_trie, url_rules

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD_BPE, BYTE_BPE = (public_tokenizers.path(f"{name}.json") for name in ("word_bpe_49k", "byte_bpe_50k"))


def clash(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


# earlier operators


def test_token_sets_are_told_apart(spark):
    """Urls whose tokens run together alike keep verdicts of their own."""
    mined = spark.createDataFrame([(0, ["a", "path=b"], 0.9, 10)], "rule_id long, tokens array<string>, confidence double, support long")
    pages = spark.createDataFrame([(1, "x://h/1"), (2, "x://h/2")], "page_id long, url string")
    sets = spark.createDataFrame([('["a","path=b"]', ["a", "path=b"]), ('["a path=b"]', ["a path=b"])], "key string, tokens array<string>")
    assert [r["key"] for r in url_rules.matched(sets, mined).collect()] == ['["a","path=b"]']
    assert url_rules.judge(pages, mined).count() == 2


def test_copies_with_different_labels(spark):
    """The labels of copies are decided by the text, not by the order of rows."""
    rows = [(i, f"kind words {i // 4} again" if i % 3 else f"vile slur {i // 4} spat") for i in range(240)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0 or i % 7 == 0)) for i in range(240)], "doc_id long, toxic int")
    models = [toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 5)]
    assert models[0].grams == models[1].grams and abs(models[0].bias - models[1].bias) < 1e-6


# spelling variants


def plain_variants(counts, times):
    words = sorted(counts)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w in words:
        others = [v for v in words if v != w and near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
        out[w] = [form[w], None, counts[w], len(others), counts[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(o) for w, o in out.items()}


def got_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants(spark):
    """Short words over few letters: many neighbours, runs of equal letters, chains of forms, borders in every trie."""
    r = random.Random(7)
    counts = {"".join(r.choice("abé") for _ in range(r.randrange(1, 7))): r.choice([2, 2, 3, 30, 40, 500, 6000]) for _ in range(400)}
    counts |= {"long" * 5000: 2, "long" * 5000 + "x": 40, "long" * 2500 + "y" + "long" * 2500: 700}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    small = {w: n for w, n in counts.items() if len(w) < 100}
    got = got_variants(spelling.variants(df, times=10))
    assert {w: got[w] for w in small} == plain_variants(small, 10)
    long = {w: n for w, n in counts.items() if len(w) > 100}
    assert {w: got[w] for w in long} == plain_variants(long, 10)
    assert any(f and f != root for f, root, *_ in got.values())


def test_word_counts(spark):
    rows = [
        (1, "Straße strasse STRASSE Über ÜBER naïve"), (None, "Strasse x"), (2, None), (3, ""), (3, "strasse"), (3, "strasse"), (4, "a" * 50_000 + "1" + "a" * 50_000), (5, "÷÷÷ ×××"),
    ]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"), "word", "n", "id", "whole", "name")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, 3, 2).collect()}
    assert got == {"strasse": 5, "a" * 50_000: 2, "Über": 2}  # only A-Z has a lower case
    assert spelling.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    changed = Counter()
    for i in range(400):
        h = zlib.crc32(f"{i}:variant".encode())
        changed["variant" if h % 31 else "variant"[: h % 7] + "variant"[h % 7 + 1 :]] += 1
    docs = spark.createDataFrame([(i, "Variant, vaRiant") for i in range(400)], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, 6, 2, spelling.dropped_letter).collect()}
    assert got == {w: 2 * n for w, n in changed.items()} and len(got) > 1


# streaming BPE


@pytest.fixture(scope="module")
def encoder():
    return bpe_stream.Encoder(WORD_BPE)


ODD = [
    "", "a", "Σας İI ΑΣ", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "'re 're's'", "aaaaa" * 200, "日本語テキスト naïve é́", "  x \x1c y\x85z", "=-" * 900,
    "1" * 100, "a\u0000b", "😀😀👍🏽", "<|endoftext|>" * 3, "a'" * 40, "ǅ ß ﬁ ＡＢ", "퟿", " \n\t ",
]


def ids_of(encoded):
    return np.frombuffer(encoded, "<u4").tolist()


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encode_decode(path):
    library, own = Tokenizer.from_file(path), bpe_stream.Encoder(path)
    decoder = bpe_stream.Decoder(own.spec)
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("abcdetshin ' é́Σ日") for _ in range(r.randrange(200))) for _ in range(500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(own.encode(text)) == want
        raw = np.array(want, "<u4").tobytes()
        for step in (4, 12, len(raw) + 4):
            got = "".join(decoder.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + decoder.close()
            assert got == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abeintsrhé' \nQ1=<|>"), max_size=120), st.integers(1, 9))
def test_portions(encoder, text, step):
    """Whatever the portions, and wherever a text is cut, the ids are those of the whole text."""
    want = encoder.library.encode(text, add_special_tokens=False).ids
    chunk, bpe_stream.CHUNK = bpe_stream.CHUNK, 1 + step
    try:
        got = b"".join(encoder.feed(text[i : i + step]) for i in range(0, len(text), step)) + encoder.close()
    finally:
        bpe_stream.CHUNK = chunk
    assert ids_of(got) == want


def test_bounded_lookahead(encoder):
    """What is emitted of a piece early is never taken back, and little of it is held."""
    merges, r = encoder.merges, random.Random(3)
    assert merges.proper and 32 <= merges.lookahead < 5000
    for letters in ("aeinthsr", "ab", "a", "etaoinshrdlu"):
        piece = "".join(r.choice(letters) for _ in range(20_000)).encode()
        stream, got, held = bpe_stream.PieceTransducer(merges), [], 0
        for i in range(0, len(piece), 700):
            got += stream.feed(piece[i : i + 700])
            held = max(held, len(stream.held))
        got += stream.close()
        assert got == encoder.library.encode(piece.decode(), add_special_tokens=False).ids
        assert held <= stream.room + 700
    for text in ("the" * 9, "ing" * 30, "aabbaabab"):
        ids = [merges.inner[b] for b in text.encode()]
        assert merges._few(ids) == merges._many(ids)


def test_bpe_query(spark):
    library = Tokenizer.from_file(WORD_BPE)
    want = {}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op12_bpe_stream"](spark, SF_DIR).collect()}
    assert got == want


def test_bpe_cases(spark, encoder):
    long = "word " * 60_000 + "x" * 200_000 + " é" * 70_000
    rows = [(1, None), (None, ""), (2, long), (3, "twice"), (3, "twice")]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"), "n_tokens", "ids", "whole text", "ids_sha256")
    library = Tokenizer.from_file(WORD_BPE)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in bpe_stream.encoded(docs, WORD_BPE).collect()) == want
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in bpe_stream.digests(docs, WORD_BPE).collect()) == [(i, len(x)) for i, x in want]
    assert bpe_stream.digests(docs.limit(0), WORD_BPE).count() == 0
    plain = bpe_stream.Decoder(encoder.spec, plain=True)
    assert plain.feed(encoder.encode("Ein Käse, bitte")) + plain.close() == "ein käse , bitte "


# conversation trie


def plain_trie(rows, family=20, heads=4):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        base, h = c - c % family, zlib.crc32(str(c).encode()) % heads
        built[c] = turns if c == base else own.get(base, [])[:h] + turns[h:]
    members, out = {}, {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    for path, those in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaf = {p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below}
        ends = ",".join(str(c) for c in those if len(built[c]) == len(path))
        out[those[0], len(path)] = (
            members[path[:-1]][0] if path else None, len(those), sum(len(p) == len(path) + 1 for p in below), sum(leaf.values()),
            sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def got_trie(df):
    return {
        (r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()
    }


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_trie(spark, monkeypatch, size):
    """Shards of one, few and all conversations; hot turns, equal conversations, nulls, turnless rebuilt conversations."""
    monkeypatch.setattr(turn_trie, "SHARD_CONVERSATIONS", size)
    r = random.Random(size)
    rows = []
    for c in [*range(0, 110), *range(125, 140), 400]:  # the family of 125 to 139 has no base
        rows += [(c, t, r.choice(["user", None]), r.choice(["hot words here", "a b", "", None])) for t in r.choice([(0,), (None, 1), (2, 2, 2), tuple(range(6))])]
    rows += [(None, 0, "user", "lost")] + rows[:3]  # repeated rows are repeated turns
    table = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "key", "words", "h", "base", "position", "path")
    got = turn_trie.conversation_trie(table.repartition(5))
    assert got.count() == len(got_trie(got)) and got_trie(got) == plain_trie(rows)
    assert turn_trie.conversation_trie(table.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(20, t, "user", f"turn {t} " * 50) for t in range(3000)] + [(21, t, "user", f"turn {t} " * 50) for t in range(3000)]
    got = got_trie(turn_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert len(got) == 3001 and all(g[1] == 2 and g[3] == 1 for g in got.values()) and got[20, 0][4] == 3000 * 100
