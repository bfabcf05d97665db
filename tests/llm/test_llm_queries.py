"""The registered queries on the given tables: against their SQL, else against plain loops or held-out labels."""

import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from check_sql import rows_of
from tokenizers import Tokenizer

import corpus_pipeline
from srcmill.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for f in os.listdir(SF_DIR):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{SF_DIR}/{f}'")
    return db


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.sql("SELECT doc_id, text FROM documents").fetchall())


def rows(spark, name):
    return queries.QUERIES[name](spark, SF_DIR).collect()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    want = db.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints, radius=3):
    """Smallest id that is reachable over links of fingerprints, by id."""
    ids = list(prints)
    label = {i: i for i in ids}
    near = {i: [j for j in ids if (prints[i] ^ prints[j]).bit_count() <= radius] for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            least = min(label[j] for j in near[i])
            changed |= least != label[i]
            label[i] = least
    return label


def test_simhash(spark, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    label = smallest_reachable(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op4_simhash")}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in texts}
    assert any(label[i] != i for i in texts)


def test_token_files(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op6_token_files")}
    assert got == want


def test_toxicity(spark, db):
    labels = dict(db.sql("SELECT doc_id, toxic FROM labels").fetchall())
    got = rows(spark, "op7_toxicity")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    known = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in known) >= 0.85 * len(known)


def test_toxicity_recall(spark):
    """Held-out toxic texts of the languages whose signals are rarer than the English ones are found, too."""
    folder = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op7_toxicity"](spark, folder).filter("held_out").collect()}
    known = duckdb.sql(f"SELECT doc_id, lang, toxic FROM '{folder}/labels.parquet' JOIN '{folder}/documents.parquet' USING (doc_id)").fetchall()
    share = lambda chosen: sum(chosen) / len(chosen)
    assert share([found[i] for i, lang, toxic in known if i in found and toxic and lang == "en"]) >= 0.8
    assert share([found[i] for i, lang, toxic in known if i in found and toxic and lang != "en"]) >= 0.25
    assert share([found[i] for i, _, toxic in known if i in found and not toxic]) <= 0.02


def test_main_text(spark, db):
    """The pages of these tables hold one article each, in which blocks end where an element does."""
    import html

    pages = dict(db.sql("SELECT page_id, html FROM pages").fetchall())
    for r in rows(spark, "op9_main_text"):
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)
        pieces = re.split(r"<(?:p|/p|h1|/h1)\b[^>]*(?:>|\Z)", article[1] if article else "")
        pieces = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " " if "<br" in p else "", p)).split()) for p in pieces]
        assert r["text"] == "\n\n".join(p for p in pieces if p) and r["n_chars"] == len(r["text"])


def verdict(url):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].lower(), found[2]) if found else ("", "")
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, rules.get(rule)


def test_url_filter(spark, db):
    urls = dict(db.sql("SELECT page_id, url FROM pages").fetchall())
    got = rows(spark, "op2_url_filter")
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, given = verdict(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (given or ("block" if r["mined_rule"] is not None else "allow"))


def test_pipeline(spark, tmp_path):
    """Every stage against a plain form of its decision, on what the stage before it kept."""
    folder = "/root/testdata/sf0.01"  # the smallest tables with enough labels to learn from
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    table = lambda name, columns: duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet'").fetchall()
    texts = dict(table("documents", "doc_id, text"))
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], folder).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(df.columns == columns for df in kept[:5])
    ids = [[r[0] for r in df.select("doc_id").collect()] for df in kept]
    toxic = {i for i, toxic in table("labels", "doc_id, toxic") if toxic}
    dropped = set(ids[0]) - set(ids[1])
    labelled = {i for i, _ in table("labels", "doc_id, toxic")}
    assert len(dropped & toxic) >= 20 and not dropped & (labelled - toxic)
    label = smallest_reachable({i: fingerprint(texts[i]) for i in ids[1]})
    assert sorted(ids[2]) == sorted(set(label.values()))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[k : k + 10]) for (t,) in table("benchmark", "text") for w in [words(t)] for k in range(max(1, len(w) - 9))}
    leaks = {i for i in ids[2] if any(tuple(w[k : k + 10]) in windows for w in [words(texts[i])] for k in range(len(w)))}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaks)
    assert set(ids[4]) <= set(ids[3]) and max(map(ids[4].count, ids[4])) <= 2
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: [*library.encode(texts[i], add_special_tokens=False).ids, 2] for i in set(ids[4])}
    want, start = [], 0
    for i in sorted(ids[4]):
        want.append((i, start, len(tokens[i]), zlib.crc32(np.array(tokens[i], "<u4").tobytes())))
        start += len(tokens[i])
    assert sorted(tuple(r) for r in kept[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
