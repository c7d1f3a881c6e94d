"""Token counts, quality, language ID: against the library, held-out labels, and on odd rows."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repolens.llm import language_id, quality, token_counts
from repolens.llm.common import held_out
from repolens.llm.queries import QUERIES

from .cases import corpus, frame, plain_language, same

SF, SF_SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("block", [1 << 9, 16 << 20])
def test_token_counts_like_the_library(spark, block, monkeypatch):
    rows = corpus(3) + [(900 + i, t) for i, t in enumerate(["a" * 3000, "the " * 1000, "ԱՈ՗ ٣٤ 𐲀𐲁", " \u0085x", "'s's 'll", "<|endoftext|><|endoftext|>", " \n  x"])]
    monkeypatch.setattr(token_counts, "BLOCK", block)
    got = token_counts.token_counts(frame(spark, rows), BPE, public_tokenizers.PATTERN, limit=20).collect()
    t = Tokenizer.from_file(BPE)
    count = lambda x: len(t.encode(x or "", add_special_tokens=False))
    same(got, [(i, len((x or "").encode()), count(x), count(x) > 20) for i, x in rows])


def test_empty_tables(spark):
    none = frame(spark, corpus()).where("false")
    assert token_counts.token_counts(none, BPE, public_tokenizers.PATTERN).count() == 0
    p = language_id.learn(none)
    assert p.languages == [] and language_id.predict(none, p).count() == 0
    m = quality.fit(none, none.selectExpr("doc_id", "1 as quality"))
    assert quality.score(none, m).count() == 0


def test_language_on_odd_rows(spark):
    rows = corpus(5)
    docs = frame(spark, rows)
    p = language_id.learn(docs)
    assert p.languages == ["en"]
    got = language_id.predict(docs, p).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in rows:
        if i is not None:
            assert (by[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= by[i].score <= 1
    none = language_id.predict(docs, language_id.Profiles([], np.zeros((0, language_id.DIM), np.float32))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    whole = language_id.predict(docs, p, whole_rows=True)
    assert whole.select("row.*").columns == docs.columns and whole.count() == len(rows)


def test_trigrams_against_letter_by_letter():
    letters = language_id._Letters()
    texts = ["Ab,  c!", "", "é日", "...x", "a\0b"]
    doc, code, found, of = language_id._codes(texts, letters)
    vectors = language_id._vectors(found, of)
    bundle = np.zeros((len(texts), language_id.DIM))
    np.add.at(bundle, doc, vectors[code])
    for i, t in enumerate(texts):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = " " + " ".join(s.split()) + " "
        want = np.zeros(language_id.DIM)
        row = lambda c: np.ones(language_id.DIM, int) if c == " " else letters.rows[letters.of[ord(c)]].astype(int)
        for a, b, c in zip(s, s[1:], s[2:]):
            want += np.roll(row(a), 2) * np.roll(row(b), 1) * row(c)
        assert (bundle[i] == want).all(), t


def test_language_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    import zlib
    learned = [(r.text or "", r.lang) for r in docs if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    want = plain_language([r.text for r in docs], learned)
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, SF_SMALL).collect()}
    for r, (lang, score) in zip(docs, want):
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-5


def test_language_of_long_texts_and_rich_scripts_in_blocks(spark, monkeypatch):
    """Slices, and blocks of trigrams, change nothing but the memory."""
    r = random.Random(4)
    rich = "".join(chr(0x4E00 + r.randrange(20_000)) for _ in range(3000))
    rows = [(i, t) for i, t in corpus(7) if i is not None] + [(900, "word " * 3000 + "end"), (901, rich), (902, rich[:50] + " " + "tail of the text")]
    docs = frame(spark, rows)
    p = language_id.learn(docs)
    want = {x.doc_id: x for x in language_id.predict(docs, p).collect()}
    monkeypatch.setattr(language_id, "CELLS", 1 << 10)
    assert np.allclose(language_id.learn(docs).vectors, p.vectors, atol=1e-6)
    monkeypatch.setattr(language_id, "PIECE", 1000)
    assert "".join(language_id._slices("word " * 3000 + "end")) == "word " * 3000 + "end"
    for x in language_id.predict(docs, p).collect():
        assert x.lang_pred == want[x.doc_id].lang_pred
        assert abs(x.score - want[x.doc_id].score) < (1e-6 if x.doc_id != 901 else 0.02)
    letters = language_id._Letters()
    import tracemalloc
    text = "".join(chr(0x4E00 + r.randrange(20_000)) for _ in range(200_000))
    monkeypatch.undo()
    language_id._bundles([text], letters, np.zeros(1, np.int64), 1)
    tracemalloc.start()
    language_id._bundles([text], letters, np.zeros(1, np.int64), 1)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_language_held_out(spark):
    got = QUERIES["op4_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.where(F.col("held_out") != held_out(F.col("doc_id"), 4, 2)).count() == 0


def test_quality_on_odd_rows(spark, monkeypatch):
    rows = corpus(6)
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, most_rows=30)
    a = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in quality.score(docs, model).collect())
    assert len(a) == len(rows) and all(0 <= x[2] <= 1 for x in a)
    monkeypatch.setattr(quality.bytescan, "PIECE", 1 << 12)  # the long text now comes in parts
    from repolens.llm import bytescan
    data = [t or "" for _, t in rows]
    import pyarrow as pa
    parts = list(quality._bags(pa.RecordBatch.from_arrays([pa.array(data)], names=["t"]), 0))
    whole = sum(int(x[2][:, :quality.WORDS].sum(dtype=np.int64)) for x in parts)
    assert whole == sum(len(t.encode().split()) for t in data)
    bytescan._powers.clear()


def test_quality_fit_keeps_its_bounds(spark, monkeypatch):
    rows = [(1, f"text number {i} " * 3) for i in range(300)] + [(2, "long " * 400), (3, None), (4, "some words")] + [(5, "the same text")] * 50
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, x, bag, y: seen.append((len(x), sorted(bag.tolist()), y.tolist())))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    quality.fit(docs, labels, most_rows=20, most_passages=4)
    n, bag, y = seen.pop()
    assert len(y) == 20 and len(set(bag)) == 20 and n == 20  # texts of one id are documents each; the long one is left out whole
    quality.fit(docs, labels.where("doc_id <> 1"), most_rows=20, most_passages=8)
    assert len(seen.pop()[2]) == 4  # the repeated row counts once
    quality.fit(docs, labels.where("doc_id <> 1"), most_rows=20, most_passages=8, most_total=3)
    assert seen.pop()[0] <= 3


def test_quality_score_against_a_plain_version(spark):
    """Passage by passage, word by word."""
    from repolens.llm import bytescan
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    p = {k: v.astype(float) for k, v in model.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    kind = lambda b: 1 if b >= 128 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b

    def hashed(w):
        raw = np.frombuffer(w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w), np.uint8)
        return int(bytescan.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])

    def plain(text):
        words = [w for w in (text or "").encode().split()]
        bags = [words[i:i + quality.PASSAGE] for i in range(0, len(words), quality.PASSAGE)] or [[]]
        h, e, before = [], [], None
        for bag in bags:
            x = np.zeros(quality.DIM)
            for w in bag:
                x[hashed(w) % quality.WORDS] += 1
                shape = np.array([(kind(w[0]) * 256 + kind(w[-1])) * 16 + min(len(w), 15) + 1], np.uint64)
                x[quality.WORDS + int(bytescan.mix(shape)[0]) % quality.SHAPES] += 1
                x[quality.DIM - (2 if hashed(w) == before else 1)] += 1
                before = hashed(w)
            f = np.sqrt(x / max(x[:quality.WORDS].sum(), 1))
            h.append(np.tanh(f @ p["W"] + p["b"]))
            e.append((np.tanh(h[-1] @ p["V"]) * sigmoid(h[-1] @ p["U"])) @ p["w"])
        a = np.exp(np.array(e) - max(e))
        return float(sigmoid((a / a.sum()) @ np.array(h) @ p["c"] + p["c0"]))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    near = [abs(got[r.doc_id] - plain(r.text)) for r in docs.collect()]
    # the first word of a batch counts as a repeat
    assert len(near) == 200 and max(near) < 0.02 and sorted(near)[-5] < 1e-4


def test_quality_held_out(spark):
    got = (QUERIES["op2_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", "quality", "predicted").toPandas())
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (got.predicted == (got.score >= 0.3)).all()


def test_attention_gradient():
    """The learned weights lower the loss, and the attention of a bag sums to 1 by construction of the score."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (60, quality.DIM)).astype(np.uint8)
    bag = np.repeat(np.arange(20), 3)
    y = (np.arange(20) % 2).astype(np.float32)
    x[np.isin(bag, np.flatnonzero(y)), 7] = 40
    m = quality.Model()
    m.fit(x, bag, y, epochs=60, batch=8)
    h, e = m.passages(quality._features(x))
    a = np.exp(e).reshape(20, 3)
    a /= a.sum(1, keepdims=True)
    p = quality._sigmoid((h.reshape(20, 3, -1) * a[:, :, None]).sum(1) @ m.p["c"] + m.p["c0"])
    assert ((p > 0.5) == (y == 1)).all()
