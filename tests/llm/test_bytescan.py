import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from repolens.llm import bytescan as B

TEXTS = st.lists(st.text(alphabet="ab \t\n\x0b\x1cé日\x00", max_size=40), min_size=1, max_size=6)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts):
    data, off = B.flat(pa.array(texts))
    starts, ends, first = B.words(data, off)
    h = B.span_hashes(data, starts, ends)
    seen = {}
    for i, t in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", t)
        got = [bytes(data[a:b]).decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])]
        assert got == want == [w.decode() for w in t.encode().split()]
        for w, x in zip(want, h[first[i]:first[i + 1]]):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_ladder_tells_runs_apart(units, length):
    h = B.mix(np.array(units, np.uint64) + np.uint64(1))
    out = B.ladder(h, length)
    assert len(out) == max(0, len(units) - length + 1)
    runs = [tuple(units[i:i + length]) for i in range(len(out))]
    assert len(set(zip(runs, out.tolist()))) == len(set(runs)) == len(set(out.tolist()))


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_minimisers(values, width):
    h = np.array(values, np.uint64) << np.uint64(40)
    got = B.minimisers(h, width) if len(h) >= width else np.zeros(0, int)
    want = [i + int(np.argmin(values[i:i + width])) for i in range(len(values) - width + 1)]
    assert got.tolist() == want


def test_long_words_and_texts_in_parts(monkeypatch):
    t = "x" * 50 + " " + "ab cd " * 30 + "y" * 90
    data, off = B.flat(pa.array([t]))
    starts, ends, _ = B.words(data, off)
    monkeypatch.setattr(B, "PIECE", 16)
    B._powers.clear()
    parts = list(B.cuts(data, 0, len(data), 16))
    assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert sum(len(B.words(data[a:b], np.array([0, b - a]))[0]) for a, b in parts) == len(starts)
    h = B.span_hashes(data, starts, ends)
    assert len(set(h.tolist())) == 4
    B._powers.clear()


def test_flat_nulls_and_slices():
    data, off = B.flat(pa.array(["ab", None, "", "é"]).slice(1))
    assert bytes(data) == "é".encode() and off.tolist() == [0, 0, 0, 2]
