"""Small tables with everything that operators must bear, and plain versions of what they compute."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from repolens.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `score` double, `KEY` int, `copy` string, `cls` int"


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty and odd texts, a repeated row and a long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)] + ["Über", "naïve", "日本", "x y"]
    prose = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = prose(70)
    texts = [prose(r.randint(1, 150)) for _ in range(n)]
    for i in range(0, n, 6):
        texts[i] = prose(20) + " " + passage + "\n" + prose(10)
    base = prose(120).split()
    for i in range(1, n, 5):
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(len(copy))] = r.choice(vocab)
        texts[i] = " ".join(copy)
    texts[8] = texts[2]
    texts += [None, "", "   \n\t", "one", "One two", "one TWO", "a b c d", "ab " * 400, "z" * 700, "é" * 300, "　 wide", "nul\0byte <|endoftext|> end",
              prose(3000), texts[0], texts[0].replace(" ", "  \n")]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[5]), (None, texts[0]), (None, None), (None, texts[3]), (-3, texts[1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 3 else None, None if i is None or i % 4 == 0 else f"s{i % 4}", 7, "r", 0.5, 1, "c", 2)
                                  for i, t in rows], SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_set(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(rows):
    """(id, set size, component) of each row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def byte_cut(rows, width=200):
    """(id, bytes, removed, spans, kept bytes) of each row."""
    count = Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        if d is not None:
            count.update(b[a:a + width] for a in range(len(b) - width + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for a in range(len(b) - width + 1):
            if d is not None and count[b[a:a + width]] > 1:
                gone[a:a + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def word_cut(rows, width=50):
    """(id, words, removed, kept) of each row."""
    first = {}
    for d, t in rows:
        w = words(t)
        for a in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[a:a + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if d is not None and first[tuple(w[a:a + width])] < d:
                gone[a:a + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def plain_language(rows, learned):
    """Letter by letter: (language, cosine) of each text."""
    letters, seen = language_id._Letters(), {}

    def vector(c):
        if c not in seen:
            at = letters.index(np.array([ord(c)]))[0]
            seen[c] = np.ones(language_id.DIM) if c == " " else letters.rows[at].astype(float)
        return seen[c]

    def bundle(t):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = " " + " ".join(s.split()) + " "
        out = np.zeros(language_id.DIM)
        for tri, n in Counter(zip(s, s[1:], s[2:])).items():
            out += n * np.roll(vector(tri[0]), 2) * np.roll(vector(tri[1]), 1) * vector(tri[2])
        return out
    profile = {}
    for t, lang in learned:
        profile[lang] = profile.get(lang, 0) + bundle(t)
    out = []
    for t in rows:
        b = bundle(t or "")
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
        else:
            score = {k: float(b @ v / np.linalg.norm(b) / np.linalg.norm(v)) for k, v in profile.items()}
            best = min(score, key=lambda k: (-round(score[k], 12), k))
            out.append((best, min(1.0, max(0.0, score[best]))))
    return out


def key(x):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in x)


def same(a, b):
    a, b = sorted(map(tuple, a), key=key), sorted(map(tuple, b), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y
