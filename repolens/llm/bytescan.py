"""Vectorised scanning of text columns inside a task: words, fingerprints, minimisers.

All functions work on the flat UTF-8 bytes of one piece of an Arrow batch, with the offsets of its documents; memory is
bounded by the piece (``pieces``), not by the batch.  Fingerprints are 64 bits wide, depend on content only and are the
same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19  # bytes of text handled at once; a longer document is a piece of its own

#: What separates words: space, \t, \n, \v, \f, \r.
IS_SEP = np.zeros(256, bool)
IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over all 64 (in place)."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of the ordered pair (a, b)."""
    return mix(a * _BASE + b)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > PIECE + 1:
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets (rows + 1); null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) with at most ``most`` bytes each, or a single longer row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, off: np.ndarray, separates: np.ndarray = IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document (rows + 1) the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~separates[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte spans; powers are counted from the start of each block of 512 KB, so that
    memory for them is bounded; a span that is longer than a block is hashed block by block."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + PIECE, "right"))
        if j <= i:  # a span longer than a block
            h = np.zeros(1, np.uint64)
            for a in range(lo, int(ends[i]), PIECE):
                b = min(a + PIECE, int(ends[i]))
                h = join(h, span_hashes(data, np.array([a]), np.array([b])))
            out[i] = h[0]
            i += 1
            continue
        hi = int(ends[j - 1])
        up, down = powers(PIECE + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[:hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def ladder(h: np.ndarray, length: int, step: int = 1) -> np.ndarray:
    """Fingerprints of all runs of ``length`` units, from those of the runs of ``step`` units (by doubling)."""
    parts, at, have = [], h, step
    rest = length // step
    while rest:
        if rest & 1:
            parts.append((at, have))
        rest >>= 1
        if rest:
            at = join(at[:max(0, len(at) - have)], at[have:])
            have *= 2
    out, covered = None, 0
    for part, size in reversed(parts):  # the longest first
        n = max(0, len(h) - (length - step))
        piece = part[covered:covered + n]
        out = piece.copy() if out is None else join(out[:len(piece)], piece)
        covered += size
    return out


def bytes_hashes(data: np.ndarray) -> np.ndarray:
    """Fingerprints of all runs of 8 bytes."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    return mix(x)


def minimisers(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` fingerprints the index of the smallest of them, the first among equals.

    The index takes the low 24 bits of the compared number, so a piece has at most 2**24 units."""
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[:len(m) - (width - have)], m[width - have:])
    return (m & low).astype(np.int64)


def cuts(data: np.ndarray, lo: int, hi: int, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Split bytes [lo, hi) of one document into ranges of about ``most`` bytes that end after a separator; a word longer
    than that stays whole."""
    while hi - lo > most:
        at, found = lo + most, None
        while at < hi and found is None:
            gap = np.flatnonzero(IS_SEP[data[at:min(at + most, hi)]])
            found = at + int(gap[0]) + 1 if len(gap) else None
            at += most
        if found is None or found >= hi:
            break
        yield lo, found
        lo = found
    yield lo, hi


def super_kmers(kmers: np.ndarray, windows: np.ndarray, first: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of ``width`` units that share their minimiser, inside documents.

    ``kmers`` and ``windows`` are fingerprints of the runs of ``k`` and ``width`` units; ``first`` (documents + 1) the unit at
    which each document begins.  Returns document, first window, number of windows, the minimiser's fingerprint, and a
    fingerprint of the run's whole content: its first and last window, which overlap, and where the minimiser stands."""
    n = len(windows)
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = minimisers(kmers, width - k + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(doc[:n] == doc[width - 1:])
    mine = at[inside]
    begins = np.ones(len(inside), bool)
    begins[1:] = (mine[1:] != mine[:-1]) | (inside[1:] != inside[:-1] + 1)
    b = np.flatnonzero(begins)
    i0, i1, p = inside[b], inside[np.concatenate([b[1:], [len(inside)]]) - 1] if len(b) else inside[b], mine[b]
    content = join(join(windows[i0], windows[i1]), ((i1 - i0) << 32 | (p - i0)).astype(np.uint64))
    return doc[i0], i0 - first[doc[i0]], i1 - i0 + 1, kmers[p], content
