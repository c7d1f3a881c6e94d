"""Jaccard join, suffix dedup, substring dedup, leaks: against brute force, also by the ways for crowded groups and long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from repolens.llm import bytescan, common, decontaminate, jaccard_join, repeats, substring_dedup, suffix_levels

from .cases import byte_cut, corpus, frame, jaccard_components, same, word_cut


def cluster(seed):
    """Many near copies of a text, and many texts that share a passage but little else."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(90)] = word()
        rows.append((i, " ".join(t)))
    for i in range(60, 110):
        rows.append((i, " ".join([word() for _ in range(r.randint(0, 40))] + passage + [word() for _ in range(r.randint(0, 5))])))
    return rows


@pytest.mark.parametrize("rows, short, block", [(corpus(1), 128, 2 << 20), (corpus(2), 2, 1 << 11), (cluster(3), 8, 1 << 12), (cluster(4), 128, 2 << 20)])
def test_jaccard_components(spark, rows, short, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "GATHER", 500)
    got = jaccard_join.join(frame(spark, rows)).collect()
    same(got, jaccard_components(rows))


def test_overlaps_and_forest():
    rng = np.random.default_rng(2)
    a = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    b = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(25)]
    assert jaccard_join._overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert jaccard_join._overlaps(a, a).tolist() == [[len(np.intersect1d(x, y)) for y in a] for x in a]
    x, y = np.array([0, 1, 0, 3, 4]), np.array([1, 2, 2, 4, 3])
    assert jaccard_join._forest(x, y, 5) == [0, 1, 3]


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(139, 200), (-5, 200), (7, 7), (None, 3), (50, 51), (51, 50)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: -5 for i in [-5, 200, *range(100, 140)]}, 50: 50, 51: 50}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows, most, piece, batches", [(corpus(1), 1024, 1 << 19, 4), (corpus(2), 1, 1 << 10, 3), (cluster(3), 4, 1 << 19, 1)])
def test_suffix_dedup(spark, rows, most, piece, batches, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_CLASSES", most)
    monkeypatch.setattr(repeats, "SLICE", 700)
    monkeypatch.setattr(bytescan, "PIECE", piece)
    bytescan._powers.clear()
    docs = frame(spark, rows)
    out = suffix_levels.dedup(docs, batches=batches)
    assert out.select("row.*").columns == docs.columns
    same([(r.row.doc_id, r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()], byte_cut(rows))
    bytescan._powers.clear()


def test_suffix_levels_merge_by_doubling(spark):
    index = suffix_levels.SuffixIndex(spark)
    batches = [[1, 2, 2], [3, 1], [4], [5, 3], [1]]
    shapes, seen = [], Counter()
    for keys in batches:
        found = {r.key for r in index.append(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
        old = set(seen)
        seen.update(keys)
        assert found == {k for k in keys if k in old or keys.count(k) > 1}
        shapes.append(sorted(index.levels))
    assert shapes == [[0], [1], [0, 1], [2], [0, 2]]
    assert {r.key: r.n for r in spark.table(index.levels[2]).collect()} == Counter(sum(batches[:4], []))
    index.drop()


def test_suffix_text_form_keeps_whole_characters(spark):
    t = "é" * 150
    rows = [(1, "x" + t + "日"), (2, "é" + t)]
    for r in suffix_levels.dedup(frame(spark, rows), as_text=True).collect():
        r.kept.encode()
        assert len(r.kept) <= 3


@pytest.mark.parametrize("rows, most, piece", [(corpus(1), 1024, 1 << 19), (corpus(2), 1, 1 << 10), (cluster(3), 4, 1 << 19)])
def test_substring_dedup(spark, rows, most, piece, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_CLASSES", most)
    monkeypatch.setattr(repeats, "SLICE", 130)
    monkeypatch.setattr(bytescan, "PIECE", piece)
    bytescan._powers.clear()
    docs = frame(spark, rows)
    out = substring_dedup.dedup(docs)
    assert out.select("row.*").columns == docs.columns
    same([(r.row.doc_id, r.n_units, r.n_removed, r.kept) for r in out.collect()], word_cut(rows))
    bytescan._powers.clear()


def test_empty_tables(spark):
    none = frame(spark, corpus()).where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.join(none).count() == 0
    assert suffix_levels.dedup(none).count() == 0
    assert substring_dedup.dedup(none).count() == 0
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(frame(spark, corpus()), items).count() == 0


def grams(words):
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def test_leaks_against_every_window(spark):
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [(i, prose(r.randint(15, 50))) for i in range(12)] + [(90, prose(4)), (91, ["a"] * 30)]
    docs = []
    for i in range(80):
        t = prose(r.randint(0, 60))
        if i % 3:
            p = list(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 1, 3, 8])):
                p[r.randrange(len(p))] = r.choice(vocab)
            t = t + p + prose(r.randint(0, 30))
        docs.append((i, t))
    docs += [(100, items[0][1][1:]), (101, []), (102, ["a"] * 31)]
    tables = (frame(spark, [(i, " ".join(t).upper() + ".") for i, t in docs] + [(200, None), (100, " ".join(items[0][1][1:])), (None, None)]),
              spark.createDataFrame([(i, ", ".join(t)) for i, t in items] + [(99, None), (98, "")], "item_id long, text string"))
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(*tables).orderBy("similarity").collect()}
    want = {}
    for d, t in docs:
        for i, p in items:
            if len(p) >= 5 and len(t) >= 5:
                q = grams(p)
                best = max(sum((w & q).values()) / sum((w | q).values()) for w in (grams(t[a:a + len(p)]) for a in range(max(1, len(t) - len(p) + 1))))
                if best >= 0.8:
                    want[d, i] = best
    assert set(got) == set(want) and len(want) > 10
    for k, x in got.items():
        assert abs(x.similarity - want[k]) < 1e-9
    kept = decontaminate.without_leaks(tables[0], decontaminate.leaks(*tables))
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} | {200, None}


def test_leaks_of_short_items(spark):
    """The very same words in the same order, in a text of any length."""
    items = spark.createDataFrame([(1, "Paris"), (2, "two  words"), (3, "a b a b"), (4, ""), (5, None), (6, "no such thing")], "item_id long, text string")
    rows = [(10, "two words, two; words"), (11, "a b a b a b"), (12, "paris" + " x" * 90_000 + " two words"), (13, None), (14, "words two"), (None, "PARIS")]
    got = {(x.doc_id, x.item_id, x.start, x.n_words) for x in decontaminate.leaks(frame(spark, rows), items, short_items=True).collect()}
    assert got == {(10, 2, 0, 2), (10, 2, 2, 2), (11, 3, 0, 4), (11, 3, 2, 4), (12, 1, 0, 1), (12, 2, 90_001, 2), (None, 1, 0, 1)}
    assert decontaminate.leaks(frame(spark, rows), items).count() == 0


def test_leaks_of_moved_text(spark):
    """All windows of all documents, also where the item's parts have changed places, and of two texts under one id."""
    r = random.Random(8)
    vocab = ["v%d" % i for i in range(500)]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [(i, prose(m)) for i, m in enumerate([50, 50, 40, 60, 25, 30])] + [(90, prose(5)), (91, ["a", "b", "c"] * 9)]
    docs = []
    for i, p in items:
        for cut in {len(p) // 2, len(p) // 3, len(p) - 6} - {0, -1}:
            docs.append((len(docs), prose(r.randint(0, 30)) + p[cut:] + p[:cut] + prose(r.randint(0, 30))))
        third = len(p) // 3
        docs.append((len(docs), prose(20) + p[:third] + p[2 * third:] + p[third:2 * third] + prose(20)))
        docs.append((len(docs), prose(3) + p + prose(10) + p))
        docs.append((len(docs), p[2:]))
    docs += [(500, prose(7) + items[0][1]), (500, prose(7) + items[0][1][:-2] + prose(2)), (500, prose(7) + items[1][1])]
    tables = (frame(spark, [(i, " ".join(t)) for i, t in docs]), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    want = set()
    for d, t in docs:
        for i, p in items:
            q, m = grams(p), min(len(p), len(t))
            for a in range(len(t) - m + 1):
                w = grams(t[a:a + m])
                s = sum((w & q).values()) / max(1, sum((w | q).values()))
                if s >= 0.8:
                    want.add((d, i, a, m, round(s, 9)))
    got = [(x.doc_id, x.item_id, x.start, x.n_words, round(x.similarity, 9)) for x in decontaminate.leaks(*tables).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    # SimHash may pass over a window at the threshold.
    assert {x for x in want if x[4] >= 0.85} <= set(got) and len(want) - len(got) <= 0.02 * len(want)
    assert {x[:2] for x in got} == {x[:2] for x in want}


def test_simhash_blocks_find_all_within_radius():
    edges = [i * 64 // (decontaminate.RADIUS + 1) for i in range(decontaminate.RADIUS + 2)]
    assert edges[0] == 0 and edges[-1] == 64 and len(set(edges)) == decontaminate.RADIUS + 2
    r = random.Random(1)
    for _ in range(500):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), decontaminate.RADIUS):
            y ^= 1 << b
        assert any(x >> lo & (1 << hi - lo) - 1 == y >> lo & (1 << hi - lo) - 1 for lo, hi in zip(edges, edges[1:]))


def test_simhash_and_similarity_in_spark(spark):
    from pyspark.sql import functions as F
    a = ["one two three four five six seven eight", "x y z x y z x y z x y z", "short one"]
    d = spark.createDataFrame([(t,) for t in a], "t string").select(decontaminate._shingles(decontaminate._words(F.col("t"))).alias("s"))
    for r in d.select("s", decontaminate._simhash(F.col("s")).alias("f"), decontaminate._similarity(F.col("s"), F.col("s")).alias("one")).collect():
        bits = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in r.s) > len(r.s) / 2)
        assert r.f & (1 << 64) - 1 == bits
        assert r.one == (1.0 if r.s else None)


def test_contract_digests(spark):
    from repolens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    same(QUERIES["op9_suffix_dedup"](spark, sf).collect(), [(*x[:4], hexed(x[4])) for x in byte_cut(rows)])
    same(QUERIES["op10_substring_dedup"](spark, sf).collect(), [(*x[:3], hexed(x[3].encode())) for x in word_cut(rows)])
    same(QUERIES["op7_jaccard_join"](spark, sf).collect(), jaccard_components(rows))
    found = QUERIES["op8_benchmark_leaks"](spark, sf).collect()
    w = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: w(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {d: " ".join(w(t or "")) for d, t in rows}
    exact = {(d, i) for d, t in texts.items() for i, p in items.items() if f" {' '.join(p)} " in f" {t} "}
    assert exact <= {(r.doc_id, r.item_id) for r in found}
