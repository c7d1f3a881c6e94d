"""The pipeline's rows against plain versions of its five stages, and rows that share an id or have none."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import pandas as pd
import pytest
from repolens.llm import language_id
from repolens.llm.common import written

from .cases import byte_cut, corpus, jaccard_components, plain_language, shingle_set, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `row_key` string"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def trigrams(t):
    s = "".join(c if c.isalpha() else " " for c in (t or "").lower())
    s = " " + " ".join(s.split()) + " "
    return len(set(zip(s, s[1:], s[2:]))) if s.strip() else 0


def plain_known(rows):
    learned = [(r[1] or "", r[2]) for r in rows if r[2] is not None]
    found = plain_language([r[1] for r in rows], learned)
    least = corpus_pipeline.LEAST_LANGUAGE_SCORE
    return [r for r, (lang, score) in zip(rows, found)
            if lang != "und" and not (trigrams(r[1]) >= corpus_pipeline.ENOUGH_TRIGRAMS and score < least)]


def plain_near(rows):
    numbered = [(i, r[1]) for i, r in enumerate(rows)]
    group = [c for _, _, c in jaccard_components(numbered)]
    best = {}
    for i, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0, i)
        if shingle_set(r[1]):
            best[group[i]] = min(best.get(group[i], rank), rank)
    seen, out = set(), []
    for i, r in enumerate(rows):
        if shingle_set(r[1]):
            if best[group[i]][2] == i:
                out.append(r)
        elif (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out


def plain_passages(rows):
    out = []
    for r, (_, _, gone, _, kept) in zip(rows, byte_cut([(i, r[1]) for i, r in enumerate(rows)])):
        text = kept.decode("utf-8", "ignore")
        if not gone:
            out.append(r)
        elif text.strip(" "):
            out.append((r[0], text, r[2], r[3], len(text), r[5]))
    return out


def plain_leaks(rows, items):
    def terms(t):
        return [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]

    def grams(w):
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))

    def leaks(t):
        w = terms(t)
        for p in map(terms, items):
            if 0 < len(p) < 5:
                if any(w[a:a + len(p)] == p for a in range(len(w) - len(p) + 1)):
                    return True
            elif len(p) >= 5 and len(w) >= 5:
                q = grams(p)
                for a in range(max(1, len(w) - len(p) + 1)):
                    x = grams(w[a:a + len(p)])
                    if sum((x & q).values()) >= 0.8 * sum((x | q).values()):
                        return True
        return False
    return [r for r in rows if not leaks(r[1])]


def plain_mix(rows):
    mass = Counter()
    for r in rows:
        mass[r[3]] += max(1, len(r[1] or ""))
    scale = sum(mass.values()) / sum(math.sqrt(m) for m in mass.values())
    out = []
    for r in rows:
        rate = scale / math.sqrt(mass[r[3]])
        u = int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}:1".encode()).hexdigest()[:13], 16) / 2 ** 52
        n, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        out += [(*r, i + 1) for i in range(n)]
    return out


def corpus_rows(seed):
    """The odd corpus, with an alphabet that no label teaches, benchmark passages, shared passages, null ids and shared ids."""
    r = random.Random(seed)
    rows = [(i, t, "en" if i is None or i % 3 else "x", None if i is None or i % 4 == 0 else f"s{i % 4}", len(t or ""), "k") for i, t in corpus(seed)]
    foreign = ["".join(chr(0x10A0 + r.randrange(80)) for _ in range(7)) for _ in range(300)]
    rows += [(5000 + i, " ".join(r.choice(foreign) for _ in range(40)), None, "s1", 0, "k") for i in range(12)]
    item = " ".join(f"bench{r.randrange(50)}" for _ in range(30))
    free = lambda n: " ".join("free" + "abcdefgh"[r.randrange(8)] * r.randrange(1, 4) + str(r.randrange(1000)) for _ in range(n))
    rows += [(6000, free(20) + " " + item + " " + free(20), "en", "s2", 0, "k"), (None, item, "en", "s2", 0, "k"), (6001, free(30), "en", "s2", 0, "k"),
             (6001, free(10) + " " + item, "en", "s2", 0, "k"), (6002, free(9) + " exact four words here", "en", "s2", 0, "k")]
    a, b, c = free(60), free(60), free(60)
    near = lambda t: t + " end"
    rows += [(7005, a, "en", "s3", 0, "A"), (7007, near(a), "en", "s3", 0, "A"), (7005, near(b), "en", "s3", 0, "B"), (7003, b, "en", "s3", 0, "B"), (7009, c, "en", "s3", 0, "C"),
             (None, near(c), "en", "s3", 0, "C")]
    return rows, [item, "", "exact four words here", "never seen anywhere at all in these texts"]


def same_rows(got, want):
    order = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want), key=order)


@pytest.mark.parametrize("seed", [11, 12])
def test_stages_against_plain_versions(spark, tmp_path, seed):
    rows, items = corpus_rows(seed)
    pd.DataFrame({"item_id": range(len(items)), "text": items}).to_parquet(tmp_path / "benchmark.parquet")
    sizes = []
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (plain_known, plain_near, plain_passages, lambda x: plain_leaks(x, items), plain_mix)):
        got = written(stage(spark, frame(spark, rows), str(tmp_path)), "stage").collect()
        rows = plain(rows)
        same_rows(got, rows)
        sizes.append(len(rows))
    assert sizes == sorted(sizes[:4], reverse=True) + sizes[4:] and len(set(sizes[:3])) == 3 and sizes[3] < sizes[2]


def test_run_is_its_stages(spark, tmp_path):
    rows, items = corpus_rows(13)
    pd.DataFrame({"item_id": range(len(items)), "text": items}).to_parquet(tmp_path / "benchmark.parquet")
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for plain in (plain_known, plain_near, plain_passages, lambda x: plain_leaks(x, items), plain_mix):
        rows = plain(rows)
    same_rows(got, rows)


def test_rows_of_one_id_are_decided_each_on_its_own(spark):
    rows, _ = corpus_rows(14)
    got = corpus_pipeline.near_duplicates(spark, frame(spark, [r for r in rows if r[5] in "ABC"]), "").collect()
    assert sorted(((r.doc_id, r.row_key) for r in got), key=str) == [(7003, "B"), (7005, "A"), (7009, "C")]


def test_an_unlearned_alphabet_is_rejected(spark):
    r = random.Random(3)
    english = ["the quick brown fox jumps over the lazy dog and runs far away from all that noise", "some plain words about nothing in particular, as people write them every day"]
    rows = [(i, english[i % 2] + f" {i}", "en", "s", 0, "k") for i in range(40)]
    letters = [chr(0x0E01 + i) for i in range(46)]
    rows += [(100 + i, " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(30)), None, "s", 0, "k") for i in range(200)]
    rows += [(900, "dog", None, "s", 0, "k")]
    kept = {x.doc_id for x in corpus_pipeline.known_language(spark, frame(spark, rows), "").collect()}
    assert set(range(40)) | {900} <= kept and len(kept) <= 43
