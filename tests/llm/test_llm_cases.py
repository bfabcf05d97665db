"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator
from typing import get_type_hints

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from srcmill.llm import components, decontaminate, license_scan, main_text, mixing, repeats, simhash, token_files, topk, toxicity, url_rules
from srcmill.llm.tables import trimmed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in every column, repeated rows, an empty and a long text."""
    long = prose(1, 40_000)
    rows = [
        (1, prose(2, 300), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, prose(3, 50), "en", "b", 5), (5, long, "en", "b", 9),
        (6, prose(2, 300), "en", None, 1), (7, prose(4, 80), "en", "a", 1), (7, prose(4, 80), "en", "a", 1), (8, " \t\n", "de", "c", 3), (9, "one", "de", "c", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clash(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


# licence scan


def test_licences(spark, odd, none):
    mit = license_scan.TEMPLATES["MIT/text"]
    rows = [
        (1, f"Some words.\nreleased under THE mit license\nMore."), (2, mit.replace("Software", "software")), (3, f"Title\n\n{mit[: mit.index('The above')]}\n{mit[mit.index('The above') :]}\n\nThe end."),
        (4, "Released under the MIT."), (5, " ".join(mit.split()[:60])), (6, None), (7, ""), (8, "license"),
    ]
    got = {r["doc_id"]: [(m["licence"], round(m["score"], 3)) for m in r["licences"]] for r in license_scan.scan(clash(spark.createDataFrame(rows, "doc_id long, text string"), "part", "score")).collect()}
    assert got[1] == [("MIT", 1.0)] and got[2] == [("MIT", 1.0)] and ("MIT", 1.0) in got[3]
    assert got[4] == [("MIT", 0.857)] and got[5] == got[6] == got[7] == got[8] == []
    assert license_scan.scan(odd).count() == 10 and license_scan.scan(none).count() == 0


def test_licence_signals():
    """No text within the threshold is missed by the words that are asked for first."""
    r = random.Random(5)
    prepared = license_scan.prepared(license_scan.TEMPLATES, 0.8)
    signals = license_scan.signal_words(prepared)
    for name, text in license_scan.TEMPLATES.items():
        for _ in range(60):
            words = text.split()
            for _ in range(r.randrange(1, 1 + max(1, len(words) // 6))):
                words[r.randrange(len(words))] = "zzz"
            grams = set(license_scan._bigrams(" ".join(words)))
            fits = any(2 * len(grams & set(p["grams"])) / (len(grams) + len(p["grams"])) >= 0.8 for p in prepared)
            lowered = " ".join(words).lower()
            assert not fits or any(w in lowered for w in signals), name


def test_licence_signal_bigrams(spark):
    """Texts within the threshold hold a signal bigram; a single word of a licence is no signal."""
    r = random.Random(6)
    prepared = license_scan.prepared(license_scan.TEMPLATES, 0.8)
    rows = [("by and under", False), ("license, source; general: by\nreleased", False), ("According to it, published \n by cc", True), ("", False), (None, None)]
    for text in license_scan.TEMPLATES.values():
        for _ in range(40):
            words = text.lower().split()
            for _ in range(r.randrange(1, 1 + max(1, len(words) // 6))):
                words[r.randrange(len(words))] = "zzz"
            grams = set(license_scan._bigrams(" ".join(words)))
            if any(2 * len(grams & set(p["grams"])) / (len(grams) + len(p["grams"])) >= 0.8 for p in prepared):
                rows.append((" \n".join(words), True))
    assert len(rows) > 200
    df = spark.createDataFrame(rows, "text string, wanted boolean")
    assert df.filter(~license_scan.signalled(F.col("text"), prepared).eqNullSafe(F.col("wanted"))).collect() == []


# urls


def test_url_parts(spark):
    urls = ["http://A.Example.com/x?y#z", "no scheme", None, "", "x://h", "x://h?q/r", "x://H#/f", "a://b://c/d", "HTTP://WWW.EXAMPLE.COM/en/É?x=1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [(r["h"], r["p"]) for r in df.select("page_id", url_rules.host().alias("h"), url_rules.path().alias("p")).orderBy("page_id").collect()]
    assert got == [("a.example.com", "/x"), ("", ""), ("", ""), ("", ""), ("h", ""), ("h", ""), ("h", ""), ("b:", "//c/d"), ("www.example.com", "/en/É")]


def test_mined_rules(spark):
    """Rules against all token subsets, counted by loops; then their matches."""
    from itertools import combinations

    r = random.Random(3)
    rows = []
    for i in range(400):
        bad = r.random() < 0.4
        host = r.choice(["pills.shop.biz", "cheap.shop.biz"] if bad and r.random() < 0.8 else ["news.org", "blog.org", "shop.biz"])
        rows.append((f"http://{host}/{r.choice(['a', 'b'])}/{i}", bad))
    rows += [(None, True), ("http://x.y/", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    token_rows = labelled.filter("url is not null and blocked is not null").select(url_rules.tokens().alias("t"), "blocked").collect()
    n = len(token_rows)
    have, bad = {}, {}
    for row in token_rows:
        for k in range(1, len(row["t"]) + 1):
            for some in combinations(row["t"], k):
                have[some] = have.get(some, 0) + 1
                bad[some] = bad.get(some, 0) + row["blocked"]
    rules = {s: b / have[s] for s, b in bad.items() if b >= 20 and b / have[s] >= 0.5}
    rules = {s: c for s, c in rules.items() if not any(set(o) < set(s) and rules[o] >= c for o in rules)}
    mined = url_rules.mine_rules(labelled)
    got = {tuple(r["tokens"]): r["confidence"] for r in mined.collect()}
    assert got.keys() == rules.keys() and all(abs(got[s] - rules[s]) < 1e-9 for s in rules) and rules
    pages = clash(spark.createDataFrame([(1, "http://cheap.shop.biz/a/9"), (2, "http://news.org/b"), (3, None), (3, None), (4, "http://x.net/es/")], "page_id long, url string"), "host", "rule", "key", "tokens")
    verdicts = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, mined).collect())
    assert verdicts == [(1, None, "block"), (2, None, "allow"), (3, None, "allow"), (3, None, "allow"), (4, "net/es/", "block")]


def test_no_labels(spark):
    empty = spark.createDataFrame([], "url string, blocked boolean")
    rules = url_rules.mine_rules(empty)
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert rules.count() == 0 and url_rules.judge(pages, rules).first()["verdict"] == "allow"
    assert url_rules.judge(pages.limit(0), rules).count() == 0


# decontamination


def brute_matches(docs, items, length, slop):
    own = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for text in docs:
        w = own(text)
        at = {}
        for q, x in enumerate(w):
            at.setdefault(x, []).append(q)
        hit, exact, near = set(), set(), set()
        for item, t in items:
            b = own(t)
            size = min(length, len(b))
            for k in range(len(b) - size + 1 if b else 0):
                window = b[k : k + size]
                for p in range(-slop, len(w) + slop):
                    if w[max(p, 0) : p + size] == window and p >= 0:
                        hit.update(range(p, p + size))
                        exact.add(item)
                    if all(any(abs(q - p - j) <= slop for q in at.get(x, ())) for j, x in enumerate(window)):
                        near.add(item)
        out.append((len(w), len(hit), sorted(exact), sorted(near)))
    return out


def test_windows(spark):
    r = random.Random(7)
    letters = "aa bb cc dd ee".split()
    texts = [" ".join(r.choice(letters) for _ in range(r.randrange(0, 60))) for _ in range(60)] + [None, "", "Aa,BB.cc"]
    items = [(str(i), " ".join(r.choice(letters) for _ in range(r.randrange(1, 9)))) for i in range(25)] + [("90", None), ("91", ""), ("92", "zz"), ("7", "aa bb")]
    docs = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "block", "tie", "place")
    index = decontaminate.build_index(docs)
    items_df = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    found = decontaminate.search(index, items_df.unionAll(items_df), length=5, slop=2)
    got = {row["doc_id"]: (row["n_words"], row["n_hit"], row["items"], row["near_items"]) for row in decontaminate.judged(index, found).collect()}
    assert [got[i] for i in range(len(texts))] == brute_matches(texts, items, 5, 2)


def test_windows_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, prose(2, 300)[40:200]), (2, None), (None, "one")], "item_id long, text string")
    index = decontaminate.build_index(odd)
    got = decontaminate.judged(index, decontaminate.search(index, items))
    assert sorted((r["doc_id"] or 0, r["items"]) for r in got.filter("n_hit > 0").collect()) == [(1, ["1"]), (6, ["1"]), (9, [])]
    assert decontaminate.judged(index, decontaminate.search(index, items.limit(0))).filter("n_hit = 0").count() == 10
    empty = decontaminate.build_index(none)
    assert decontaminate.judged(empty, decontaminate.search(empty, items)).count() == 0
    kept = decontaminate.clean_documents(clash(odd, "tie", "bad_id"), items)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 5, 7, 7, 8, 9]
    assert kept.columns == [*odd.columns, "tie", "bad_id"]


# near-duplicates


@pytest.mark.parametrize("parts", [1, 2, 3, 4])
def test_links(spark, parts):
    """Components of fingerprints against all pairs, with correlated bits and a dense group."""
    r = random.Random(parts)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = set(base) | {0, 2**64 - 1}
    for b in base[:10]:
        for _ in range(20):
            b ^= 1 << r.randrange(64)
            b ^= r.choice([0, 1 << r.randrange(64)])
            prints.add(b)
    prints |= {7 << 40 | 1 << i | 1 << j for i in range(10) for j in range(i)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    label = {p: p for p in prints}
    while True:
        new = {p: min(label[q] for q in prints if (p ^ q).bit_count() <= 3) for p in prints}
        if new == label:
            break
        label = new
    got = {r["node"] & (2**64 - 1): r["root"] for r in components.components(simhash.links(df, 3, parts)).collect()}
    groups = lambda m: sorted(sorted(p for p in prints if m.get(p, p) == k) for k in {m.get(p, p) for p in prints})
    assert groups(got) == groups(label)


def test_large_buckets(spark, monkeypatch):
    """A dense group that is cut into cells."""
    monkeypatch.setattr(simhash, "CELL", 8)
    prints = sorted({1 << i | 1 << j for i in range(20) for j in range(i)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = components.components(simhash.links(df)).collect()
    assert len(got) == len(prints) and len({r["root"] for r in got}) == 1


def test_thresholds():
    """The dynamic programme against all threshold vectors."""
    from itertools import product

    rng = np.random.default_rng(1)
    for parts in (1, 2, 3, 4):
        costs = [np.cumsum(rng.random((5, 4)), axis=1) for _ in range(parts)]
        got = simhash.thresholds(costs, 3)
        assert (got.sum(axis=1) == 3 - parts + 1).all()
        for i in range(5):
            cost = lambda t: sum(c[i, x] for c, x in zip(costs, t) if x >= 0)  # noqa: E731, B023
            assert abs(cost(got[i]) - min(cost(t) for t in product(range(-1, 4), repeat=parts) if sum(t) == 3 - parts + 1)) < 1e-9


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = sorted(((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.near_duplicates(clash(odd, "fp", "root")).collect()))
    component = {d: c for d, _, c in got}
    assert len(got) == 10 and component[1] == component[6] == 1 and component[2] == component[3] == component[8] == 2
    assert {f for d, f, _ in got if d in (2, 3, 8)} == {0} and component[0] is None and component[7] == 7
    kept = simhash.first_of_each(clash(odd, "fp", "tie", "kept_id"))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 9] and kept.columns == [*odd.columns, "fp", "tie", "kept_id"]
    assert simhash.near_duplicates(none).count() == 0 and simhash.first_of_each(none).count() == 0


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (3, 30)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# top-k


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "TILE_BLOCKS", 3)
    monkeypatch.setattr(topk, "QUERIES", 5)
    r = random.Random(2)
    vectors = {i: [r.uniform(-1, 1) if i % 3 else r.choice([-0.5, 0.25]) for _ in range(6)] for i in range(90)}
    vectors |= {90: vectors[3], 91: vectors[3], 92: [0.5], 93: []}
    rows = [*vectors.items(), (94, None), (95, [1.0, None]), (96, [float("nan")]), (97, [float("inf")]), (None, [1.0]), (0, vectors[0])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "lead", "part", "ids")
    numbers = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors.items()}
    asked = topk.whole_numbers(df.filter("vec_id % 10 = 0"))
    got = sorted(tuple(x) for x in topk.search(topk.build_index(topk.whole_numbers(df.filter("vec_id <> 0 or vec_id is null"))), asked, 5).collect())
    want = []
    for q in range(0, 91, 10):
        score = {i: sum(a * b for a, b in zip(numbers[q], v)) for i, v in numbers.items() if i not in (q, 0)}
        want += [(q, k + 1, i, score[i]) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])]
    assert got == want
    index = topk.build_index(topk.whole_numbers(df.limit(0)))
    assert topk.search(index, asked, 5).count() == 0


def test_block_pruning():
    """Blocks whose bound is too low are not scored, and large numbers stay exact."""
    rng = np.random.default_rng(0)
    x = np.zeros((640, 16), np.int64)
    x[np.arange(640), np.arange(640) // 64] = rng.integers(100, 200, 640)
    cuts = np.arange(0, 640, topk.BLOCK)
    q = np.eye(16, dtype=np.int64)[:3]
    *_, scored = topk.best_of_tile(q, np.array([-1, -2, -3]), x, np.arange(640), np.maximum.reduceat(x, cuts), np.minimum.reduceat(x, cuts), 5)
    assert scored == 3
    assert topk.products(np.array([[2**40, 1]]), np.array([[2**20, 1]])).tolist() == [[2**60 + 1]]


# token files


SPECIAL = ["<|endoftext|> and <|startoftext|>", "naïve Ünïcödé’s don't I'LL ŉ ĳ", "a\u0301 \u212b \u1e9e \u00ad \u0085 \u00a0 \x1c x", "日本語 テキスト 🙂", "²³¼ 12 3", "'s''s !'s", "", " \n\t ", "İstanbul ȺȾ ﬁ"]


def test_pieces():
    """Remembered pieces give the library's ids."""
    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    assert encoder.by_piece
    r = random.Random(4)
    pool = [chr(c) for c in range(1, 0x250)] + ["'s", "'ll", "don't", "the", " ", " "]
    texts = SPECIAL + ["".join(r.choice(pool) for _ in range(r.randrange(80))) for _ in range(3000)]
    texts += ["".join(c for c in t if not token_files.OTHER.search(c)) for t in texts]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, encoder.kind).tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 2], text


def test_pieces_are_cut_in_slices(monkeypatch):
    """Texts are cut into pieces at once, as the pattern cuts them one by one, and each different piece is looked up once."""
    r = random.Random(6)
    pool = [c for c in map(chr, range(1, 0x250)) if not token_files.OTHER.search(c)] + [*" stmdrevl 12.,-"] * 20 + ["'s", "'re", "'ll", "the"] * 20
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(30))).lower() for _ in range(3000)] + ["", "'", "'l", "l", "'", "s", " '", "é", "''re", "5'd's ²³'ve"]
    texts = [t for t in texts if not token_files.OTHER.search(t)]
    for some in (texts, texts[::-1], [], [""], ["", " "]):
        pieces, borders = token_files.cut(pa.array(["x'", *some], pa.large_utf8()).slice(1))
        pieces = pieces.to_pylist()
        assert [pieces[a:b] for a, b in zip(borders, borders[1:])] == [token_files.PIECES.findall(t) for t in some]
    encoder, asked = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2), []
    monkeypatch.setattr(encoder, "_known", lambda pieces: asked.extend(pieces) or [p.encode() for p in pieces])
    assert encoder.encode(["to be, or", "not to be,"]) == [b"tobe,or\2\0", b"nottobe,\2\0"]
    assert sorted(asked) == [",", "be", "not", "or", "to"]


def test_encoder_is_read_once():
    """Tasks of a worker share the tokenizer, not what they remember."""
    path = public_tokenizers.path("word_bpe_49k.json")
    first, second = token_files.Encoder(path, 2), token_files.Encoder(path, 7)
    assert first.library is second.library and first.known is not second.known
    text = "don't (stop) the-end, don't"
    assert first.encode([text])[0][:-2] == second.encode([text])[0][:-2]
    assert {"don", "'t", "stop", "the"} <= set(first.known)


def test_ids_forgotten(monkeypatch):
    """Ids stay right where what is remembered outgrows its bound."""
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    texts = [prose(i, 20).replace("a ", "a, ") for i in range(30)]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, encoder.kind).tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), max_size=40))
def test_any_text(text):
    encoder = test_any_text.__dict__.setdefault("encoder", token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2))
    assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_round_trip(spark, odd, none, tmp_path, name):
    path = f"{tmp_path}/{name}"
    rows = [(i - 4, t, None, None, None) for i, t in enumerate(SPECIAL)]
    docs = clash(odd.unionByName(spark.createDataFrame(rows, DOCS)).repartition(3), "tie", "part", "base")
    manifest = token_files.write(docs, path, public_tokenizers.path(name), 2)
    got = token_files.read(spark, path).orderBy("start").collect()
    library = token_files.Encoder(public_tokenizers.path(name), 2).library
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    assert [g["doc_id"] for g in got] == [i if known else None for (known, i), _ in want]
    assert sorted((g["doc_id"] or 0, g["n_tokens"], g["ids_crc32"]) for g in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (_, i), x in want)
    assert [g["start"] for g in got] == np.cumsum([0, *(g["n_tokens"] for g in got)])[:-1].tolist()
    assert manifest.agg(F.sum("n_ids")).first()[0] == sum(len(x) for _, x in want)
    token_files.write(none, f"{path}-none", public_tokenizers.path(name), 2)
    assert token_files.read(spark, f"{path}-none").count() == 0


# toxicity


def test_trimmed_functions():
    """A function that gives memory back keeps the type hints by which Spark knows a UDF over batches."""

    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from batches

    assert get_type_hints(trimmed(plain)) == get_type_hints(plain) and list(trimmed(plain)([1, 2])) == [1, 2]


def test_toxicity(spark, odd, none):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(i, r.randrange(5, 80)).split()
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["Scoundrel", "scoundrels!", "NITWIT"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels[:300], (None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    scored = {x["doc_id"]: x["s"] for x in docs.select("doc_id", toxicity.score(model).alias("s")).collect()}
    assert sum((scored[i] >= 0.5) == bool(t) for i, t in labels[300:]) >= 98
    assert all(0 <= x["s"] <= 1 for x in odd.select(toxicity.score(model).alias("s")).collect())
    kept = toxicity.clean_documents(clash(odd, "toxic_score"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == [*odd.columns, "toxic_score"]
    assert toxicity.fit(none, known).weights == [] and none.select(toxicity.score(model)).count() == 0
    assert toxicity.fit(docs, known.filter("toxic = 1")).weights == []


def test_rare_toxicity(spark):
    """A rare kind of toxicity is learned beside one that is twenty times as common."""
    r = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        kind = "common" if i % 5 == 0 else "rare" if i % 100 == 1 else "clean"
        words = prose(i, r.randrange(20, 60)).split()
        if kind != "clean":
            words.insert(r.randrange(len(words)), {"common": "scoundrel", "rare": "zwutz"}[kind])
        rows.append((i, " ".join(words), kind))
        labels.append((i, int(kind != "clean")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:1000], "doc_id long, toxic int"))
    flagged = {r["kind"]: r["share"] for r in docs.filter("doc_id >= 1000").groupBy("kind").agg(F.avg((toxicity.score(model) >= 0.5).cast("int")).alias("share")).collect()}
    assert flagged["common"] == flagged["rare"] == 1 and flagged["clean"] <= 0.01


def test_buckets_lose_no_gram(spark):
    """The n-grams found through buckets are those that a plain count finds, with the same surprise."""
    texts = [(prose(i, 30) + (" zwutz" if i % 9 == 0 else ""), int(i % 9 == 0 or i % 50 == 7)) for i in range(200)]
    n, counts = [sum(t == label for _, t in texts) for label in (1, 0)], {}
    for text, toxic in texts:
        for g in set(toxicity.found_grams(toxicity.normal(text), np.ones(1 << toxicity.BUCKET_BITS, bool)).tolist()):
            counts.setdefault(g, [0, 0])[1 - toxic] += 1

    def surprise(p, q):
        cells = [(p, n[0], p + q), (q, n[1], p + q), (n[0] - p, n[0], 200 - p - q), (n[1] - q, n[1], 200 - p - q)]
        return 2 * sum(k * math.log(k * 200 / (a * b)) for k, a, b in cells if k)

    want = {g: surprise(p, q) for g, (p, q) in counts.items() if surprise(p, q) >= 10}
    got = {r["gram"]: r["surprise"] for r in toxicity.telling(spark.createDataFrame(texts, "text string, toxic int"), 10.0, math.inf, 100_000, 1.0)}
    assert want and got == pytest.approx(want)


def test_grams_of_pieces(monkeypatch):
    """A text hashed in pieces has the grams of the whole, and these are its n-grams."""
    data = toxicity.normal(prose(3, 2000) + " é")
    whole, every = toxicity.found_buckets(data), np.ones(1 << toxicity.BUCKET_BITS, bool)
    grams = {int.from_bytes(data[i : i + n], "little") + (n << 40) for n in toxicity.LENGTHS for i in range(len(data) - n + 1)}
    assert set(toxicity.found_grams(data, every).tolist()) == grams and {toxicity.bucket_of(g) for g in grams} == set(whole.tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    assert (toxicity.found_buckets(data) == whole).all() and set(toxicity.found_grams(data, every).tolist()) == grams


# mixing


def test_water_fill(spark):
    """Against clamping in turn."""
    r = random.Random(11)
    for n in (1, 2, 5, 12):
        sizes = [r.choice([0, 1, 5, 100, 1000, 20000]) for _ in range(n)]
        names = [f"s{i:02d}" for i in range(n - 1)] + [None]
        got = {x["source"]: x["target"] for x in mixing.water_fill(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        weights, clamped = [(3, 1, 2)[i % 3] for i in range(n)], set()
        while True:
            left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in clamped)
            level = left / sum(weights[i] for i in range(n) if i not in clamped) if len(clamped) < n else 0
            over = {i for i in range(n) if i not in clamped and weights[i] * level >= 2 * sizes[i]}
            if not over:
                break
            clamped |= over
        for i, name in enumerate(names):
            assert abs(got[name] - (2 * sizes[i] if i in clamped else weights[i] * level)) < 1e-6


def test_mix(spark, odd, none):
    r = random.Random(12)
    rows = [(i, prose(i, r.choice([1, 10, 50, 400])), None, r.choice(["x", "x", "x", "y", "z", None]), i) for i in range(300)]
    docs = clash(spark.createDataFrame(rows, DOCS).repartition(4), "size", "target", "edge", "order_key", "s", "e", "row")
    drawn = mixing.draw(mixing.narrow_rows(docs)).collect()
    by = {}
    for x in drawn:
        assert 0 <= x["repeats"] <= 2
        got = by.setdefault(x["source"], [x["target"], 0])
        got[1] += x["repeats"] * x["size"]
    assert all(abs(target - taken) <= 0.01 * target + 1 for target, taken in by.values())
    again = mixing.draw(mixing.narrow_rows(docs.repartition(2)))
    assert sorted((x["doc_id"], x["repeats"]) for x in again.collect()) == sorted((x["doc_id"], x["repeats"]) for x in drawn)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    counts = {x["doc_id"]: x["count"] for x in mixed.groupBy("doc_id").count().collect()}
    assert counts == {x["doc_id"]: x["repeats"] for x in drawn if x["repeats"]}
    assert mixing.mixed(none).count() == 0
    assert mixing.draw(mixing.narrow_rows(odd)).count() == 10


# main text


ARTICLE = "The cat sat on the mat and it was happy with the warm sun in the window of the old house by the sea."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("no markup", ""), ("<p>", ""),
        (page(f"<nav><a href=x>Home</a></nav><article><h1>Cats</h1><p>{ARTICLE}</p><p>Short.</p></article><footer>The end of the page</footer>"), f"Cats\n\n{ARTICLE}\n\nShort."),
        (page(f"<div class='content'><h2>Cats</h2><p>{ARTICLE}<p>Yes.<div class=sidebar>{ARTICLE}</div></div>"), f"Cats\n\n{ARTICLE}\n\nYes."),
        (page(f"<article><p>{ARTICLE} a &lt;b&gt; &amp;amp; c&nbsp;&#233;</p><section id=comments><article><p>{ARTICLE}</p></article></section></article>"), f"{ARTICLE} a <b> &amp; c é"),
        (page(f"<article><p>{ARTICLE}</p><div class='ad-slot'>{ARTICLE}</div><form><p>{ARTICLE}</p></form><p>Bye <b>now</b>.</p></article>"), f"{ARTICLE}\n\nBye now."),
        (page(f"<header><h1>Site</h1></header><main><header><h1>Cats</h1></header><p>{ARTICLE}</p><ul><li><a href=1>One more</a></li></ul></main>"), f"Cats\n\n{ARTICLE}"),
        (page(f"<div class='cookie-notice'>{ARTICLE}</div><article class='has-sidebar'><p>{ARTICLE}</p></article><aside>{ARTICLE}</aside>"), ARTICLE),
        (page(f"<script>var a='<p>{ARTICLE}</p>';</script><style>p{{}}</style><!-- <p>{ARTICLE}</p> --><article><p title='a>b'>{ARTICLE}</p></article>"), ARTICLE),
        (page(f"<article><p>{ARTICLE}<br>line<br><br>break</p><div hidden>{ARTICLE}</div></article>"), f"{ARTICLE} line\n\nbreak"),
        (f"<html><body><article><p>{ARTICLE}</p><p>{ARTICLE} cut &amp", f"{ARTICLE}\n\n{ARTICLE} cut &"),
        (f"<article><p>{ARTICLE}</p><p>more <a hre", f"{ARTICLE}\n\nmore"),
    ],
)
def test_pages(html, text):
    assert main_text.main_text(html) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "<p>", "</p>", "<div class='", '"', "'", "<a href=", "<!--", "-->", "<script>", "</script>", "<article>", "</article>", "&", "&amp;", "text ", "=", "/"]), max_size=60))
def test_any_page(pieces):
    main_text.main_text("".join(pieces))


def test_extract(spark):
    rows = [(1, "u", page(f"<article><p>{ARTICLE}</p></article>")), (2, None, None), (3, "u", page(f"<article>{'<p>' + ARTICLE + '</p>' if 1 else ''}" + f"<p>{ARTICLE}</p>" * 3000))]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"), "text")
    got = {r["page_id"]: r["t"] for r in df.select("page_id", main_text.extract().alias("t")).collect()}
    assert got == {1: ARTICLE, 2: "", 3: "\n\n".join([ARTICLE] * 3001)}
    assert df.limit(0).select(main_text.extract()).count() == 0


# repeats


def brute_repeats(rows, match):
    """rows of (doc_id, text): removed places of each row; strings at one (doc_id, start) aren't earlier than each other."""
    first = {}
    order = sorted(range(len(rows)), key=lambda i: -1 if rows[i][0] is None else rows[i][0])
    data = [(rows[i][1] or "").encode() for i in range(len(rows))]
    place = lambda i, k: (-1 if rows[i][0] is None else rows[i][0], k)
    for i in order:
        for k in range(len(data[i]) - match + 1):
            w = data[i][k : k + match]
            first[w] = min(first.get(w, place(i, k)), place(i, k))
    out = []
    for i, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - match + 1):
            if first[d[k : k + match]] < place(i, k):
                gone[k : k + match] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_repeats(spark, batches):
    r = random.Random(batches)
    passages = [prose(100 + i, 30) for i in range(4)] + ["é" * 90, "ab" * 150, "z" * 260]
    rows = []
    for i in range(40):
        text = ""
        for _ in range(r.randrange(0, 5)):
            p = r.choice(passages)
            cut = r.randrange(len(p))
            text += r.choice([p, p[cut:], p[:cut], prose(r.random(), 12)]) + r.choice([" ", "\n", ""])
        rows.append((i * 3 % 41, text))
    rows += [(None, passages[0] + passages[5]), (50, None), (51, ""), (52, rows[3][1]), (52, rows[3][1]), (53, passages[1]), (53, "x" + passages[1])]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "tie", "part", "bucket")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeats(docs, 100, batches).collect()]
    want = [(d, *x) for (d, _), x in zip(rows, brute_repeats(rows, 100))]
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key) and any(x[2] for x in want)


def test_copies_stay_out_of_the_shuffle(spark):
    """Of the entries that are read together only the first of each context has a key; the others are known as repeats."""
    text = prose(1, 300)
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").coalesce(1)
    rows = repeats.Repeats(spark, 1000).entries(docs).collect()
    n = len(repeats.anchors(text.encode(), 100)[0])
    assert sum(len(r["key"]) // 8 for r in rows) == n > 10
    assert sum(len(r["pos"]) // 4 for r in rows if r["old"] is None) == 5 * n


def test_edges_in_slices(spark, monkeypatch):
    """Edges are compared a few grams at a time, with the same spans, also where a gram has more edges than a slice."""
    monkeypatch.setattr(repeats, "COMPARED", 4)
    shared = [prose(200 + i, 14)[:90] for i in range(6)]
    rows = [(i, prose(i, 8)[: 30 + i] + shared[i % 6] + prose(i % 9, 8)[:60]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeats(docs).collect()]
    want = [(d, *x) for (d, _), x in zip(rows, brute_repeats(rows, 100))]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)


def test_level_merges(spark):
    """Levels of one size merge: after 1, 2, 3, 4 batches the family has 1, 1, 2, 1 levels."""
    family = repeats.Repeats(spark, 1000)
    sizes = []
    for i in range(4):
        family.add(spark.createDataFrame([(i, prose(i, 60))], "doc_id long, text string"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4]]


def test_no_repeats(spark, odd, none):
    assert repeats.repeats(none).count() == 0
    got = {r["doc_id"]: r["n_removed"] for r in repeats.repeats(odd).collect()}
    assert got[6] == len(prose(2, 300)) and got[1] == got[2] == got[3] == got[None] == 0
