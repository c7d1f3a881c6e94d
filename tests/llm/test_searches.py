"""Exact dedup, hard negatives and lexical search: against brute force on odd rows, and their codes and tables on their own."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import exact_dedup, hard_negatives, lexical_search

from .cases import corpus, frame, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- exact dedup

@pytest.mark.parametrize("gaps", [[], [0], [0, 0, 0], [5, 0, 900, 3, 2 ** 40, 1], list(range(0, 5000, 7))])
def test_golomb_round_trip(gaps):
    rice, quotients, rests = exact_dedup.golomb(np.array(gaps, np.uint64)) if gaps != [0, 0, 0] else exact_dedup.golomb(np.zeros(3, np.uint64))
    assert exact_dedup.gaps_of(len(gaps), rice, quotients, rests).tolist() == gaps


def equal_texts(rows):
    text = [(t or "").translate(LOWER) for _, t in rows]
    ids = defaultdict(list)
    for (i, _), t in zip(rows, text):
        ids[t].append(i)
    keep = {t: max((i for i in v if i is not None), default=None) for t, v in ids.items()}
    return [(i, keep[t], len(ids[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, text)]


@pytest.mark.parametrize("seed, chunk_bits, spare", [(1, 16, 8), (2, 3, 8), (3, 2, -5)])
def test_exact_dedup(spark, seed, chunk_bits, spare, monkeypatch):
    """Also with chunks of a few rows, and with fingerprints so narrow that most rows are suspects."""
    monkeypatch.setattr(exact_dedup, "CHUNK_BITS", chunk_bits)
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", spare)
    rows = corpus(seed)
    rows += [(1000 + i, "Hot Text" if i % 2 else "hot tEXT") for i in range(90)] + [(2000, "É"), (2001, "é"), (2002, None), (2003, "ÉA"), (2004, "Éa")]
    got = exact_dedup.mark(frame(spark, rows)).collect()
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], equal_texts(rows))
    assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys({x[3] for x in equal_texts(rows)}, 1)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_rows_whole(spark):
    docs = frame(spark, corpus(4))
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    kept = sorted((r.keep_id, r.text_sha256) for r in exact_dedup.mark(docs).where("kept and keep_id is not null").collect())
    left = out.where("doc_id is not null").collect()
    assert sorted((r.doc_id, hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()) for r in left) == kept
    assert exact_dedup.mark(docs.where("false")).count() == 0 and exact_dedup.dedup(docs.where("false")).count() == 0


# -- hard negatives

def brute_mine(rows, asks, positives, negatives, low, high):
    ok = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    raw = defaultdict(list)
    for i, l, v in rows:
        if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            raw[i].append((l, v))
    out = []
    for a in sorted(i for i in raw if asks(i)):
        label, v = min(raw[a])
        mine = [math.floor(256 * x) for x in v]
        hits = sorted((-sum(x * y for x, y in zip(mine, w)), i, l) for i, l, w in ok if i != a)
        for s, p, _ in [h for h in hits if h[2] == label][:positives]:
            found = [(n, i) for n, i, l in hits if l != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("tile, anchors, lookups, dims", [(1 << 15, 64, 4096, 16), (16, 2, 5, 11), (7, 1, 64, 3)])
def test_hard_negatives(spark, tile, anchors, lookups, dims, monkeypatch):
    for name, value in (("TILE", tile), ("ANCHORS", anchors), ("ROWS", lookups)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(dims)
    rows = [(i, r.randrange(3), [r.gauss(0.2, 1) * (40 if i % 11 == 0 else 1) for _ in range(dims)]) for i in range(150)]
    rows += [(i, r.randrange(3), rows[i % 7][2]) for i in range(200, 240)]  # ties
    rows += [(300, 1, None), (301, None, [1.0] * dims), (302, 1, [float("nan")] * dims), (303, 2, [float("-inf")]), (304, 1, []), (305, 1, [0.0] * dims),
             (306, 2, [1.0]), (None, 1, [1.0] * dims), (10, rows[10][1], rows[10][2]), (20, 2, rows[21][2]), (310, 0, [1.0, None]), (320, 0, [1.0] * (dims + 9))]
    df = spark.createDataFrame([(i, l, v, 1, b"x", "t") for i, l, v in rows],
                               "vec_id long, label int, embedding array<double>, depth int, planes binary, tile string").repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, positives=3, negatives=2)
    same(got.collect(), brute_mine(rows, lambda i: i % 10 == 0, 3, 2, 80, 100))
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_bit_planes():
    rng = np.random.default_rng(3)
    for dims in (1, 8, 19):
        a, c = rng.integers(-300, 300, (5, dims)), rng.integers(-5000, 5000, (40, dims))
        c[0], c[1] = 0, -1
        depth, planes = hard_negatives.pack(c)
        assert planes.shape[1] == depth
        assert (hard_negatives.scores(planes, hard_negatives.tables(a, planes.shape[2])) == c @ a.T).all()


# -- lexical search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in rows]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None and t is not None:
            wanted[i] |= set(TERM.findall(t.translate(LOWER)))
    out = []
    for item, want in wanted.items():
        found = []
        for d, t in terms:
            tf = Counter(t)
            m = 100 - 90 + 90 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in want if tf[w])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("seed, shard, leaf, most, lookups", [(1, 1 << 20, 16, 1 << 20, 1 << 19), (2, 300, 2, 40, 60), (3, 60, 1, 1 << 20, 1 << 19)])
def test_lexical_search(spark, seed, shard, leaf, most, lookups, monkeypatch):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("MOST_TERMS", most), ("LOOKUPS", lookups), ("SAMPLE", 3)):
        monkeypatch.setattr(lexical_search, name, value)
    rows = corpus(seed) + [(3000 + i, "same Words here") for i in range(40)] + [(4000, "same\x00words\x7fhere," + " x1" * 70_000)]
    texts = [t for _, t in rows if t]
    items = [(i, " ".join(texts[i * 3].split()[:30])) for i in range(12)]
    items += [(20, "here SAME words"), (20, "one two"), (21, ""), (22, None), (None, "same"), (23, "nowhere-to-be-found zzzzzzzzz"), (24, texts[1])]
    got = lexical_search.search(frame(spark, rows), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int"), k=4)
    same(got.collect(), brute_search(rows, items, 4))


def test_lexical_search_of_nothing(spark):
    docs, items = frame(spark, corpus(1)), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(docs.where("false"), items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0


def test_interval_bounds_skip_documents():
    """One rare term decides: far fewer documents are scored than there are, and the result is that of scoring all."""
    rng = np.random.default_rng(5)
    docs, v = 4000, 30
    doc = np.repeat(np.arange(docs), 5)
    term = np.concatenate([rng.choice(v - 1, 5, replace=False) for _ in range(docs)]).astype(np.int32)
    for i in range(12):
        term[rng.integers(0, len(term))] = v - 1
    weight = np.where(np.arange(v) == v - 1, 9000, 10)
    shard = lexical_search.Shard(rng.permutation(docs).astype(np.int64), np.full(docs, 5), doc, term, np.ones(len(doc), np.int32), weight, docs, 5 * docs)
    scored = []
    plain = shard._scored
    shard._scored = lambda lo, hi: (lambda out: scored.append(len(out[0])) or out)(plain(lo, hi))
    got = shard.search(np.array([0, 3, v - 1]), 10)
    base = np.array([0, 3, v - 1]) * shard.size
    every, total = plain(np.searchsorted(shard.key, base)[:, None], np.searchsorted(shard.key, base + shard.size)[:, None])
    best = np.lexsort((every, -total))[:10]
    assert got == [(int(total[i]), int(every[i])) for i in best]
    assert sum(scored) < docs / 4
