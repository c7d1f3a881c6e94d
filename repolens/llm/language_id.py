"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A letter trigram is the product (binding) of its
letters' vectors, rotated (permuted) by two, one and no places, so that order counts.  A text is the sum (bundle) of its
trigrams; a language is the sum of the texts that carry its label; texts are compared with languages by cosine.

Equal trigrams have equal vectors, so a text's bundle is its trigram counts times the matrix of trigram vectors: one
matrix product per piece of a batch, or where a piece has very many distinct trigrams, one per block of them.  A very long
text is a sum of the bundles of its slices, cut between words.  Learning adds up vectors of ``DIM`` whole numbers per language and task, so it
covers all labelled rows; what comes to the driver is languages times ``DIM`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import arrow_schema, scan

DIM = 1024
SEED = 7
PIECE = 2 << 20
CELLS = 1 << 24  # counts (rows times distinct trigrams) and
BLOCK = 8192  # trigram vectors of a matrix product, at most
#: Labels are a closed set; more distinct ones than this are refused.
MOST_LANGUAGES = 4096


@dataclass
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # a row per language, of length 1


class _Letters:
    """Vectors of the letters seen so far, in the three rotations."""

    def __init__(self):
        self.of: dict[int, int] = {}
        self.rows = np.ones((0, DIM), np.int8)

    def index(self, points: np.ndarray) -> np.ndarray:
        new = [p for p in points.tolist() if p not in self.of]
        if new:
            rows = [np.random.default_rng((SEED, p)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1 for p in new]
            self.of |= dict(zip(new, range(len(self.of), len(self.of) + len(new))))
            self.rows = np.concatenate([self.rows, np.array(rows, np.int8)])
        return np.array([self.of[p] for p in points.tolist()], np.int64)


def _codes(texts: list[str], letters: _Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(text of each trigram, its number, codes by number, what ``_vectors`` needs).  A run of other characters counts as one
    border, and so do the two ends of a text; trigrams never span texts."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    doc = np.concatenate([[0], doc]).astype(np.int32)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    used = np.flatnonzero(seen)
    used = used[[chr(p).isalpha() for p in used]]
    number = np.zeros(0x110000, np.int32)
    number[used] = np.arange(1, len(used) + 1)
    sym = number[points]
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0
    keep[0] = True
    after = np.zeros(len(sym), bool)  # the border before a text whose predecessor has no letter at its end
    after[:-1] = sym[1:] > 0
    keep |= after & (sym == 0)
    sym, doc = sym[keep].astype(np.int64), doc[keep]
    # After a letter and before a letter may be two border marks: one is enough.
    double = np.zeros(len(sym), bool)
    double[1:] = (sym[1:] == 0) & (sym[:-1] == 0)
    sym, doc = sym[~double], doc[~double]
    ok = doc[1:-1] == doc[2:]
    k = len(used) + 1
    codes = ((sym[:-2] * k + sym[1:-1]) * k + sym[2:])[ok]
    doc = doc[2:][ok]
    if k ** 3 <= 1 << 24:
        table = np.zeros(k ** 3, bool)
        table[codes] = True
        found = np.flatnonzero(table)
        at = np.zeros(k ** 3, np.int32)
        at[found] = np.arange(len(found))
        codes = at[codes]
    else:
        found, codes = np.unique(codes, return_inverse=True)
    at = letters.index(used)
    rows = np.concatenate([np.ones((1, DIM), np.int8), letters.rows[at]])  # a border changes nothing
    return doc, codes, found, (k, rows)


def _vectors(found: np.ndarray, of: tuple) -> np.ndarray:
    """Vectors of trigrams by their codes."""
    k, rows = of
    out = np.roll(rows, 2, 1)[found // (k * k)] if len(rows) < len(found) else np.roll(rows[found // (k * k)], 2, 1)
    out *= np.roll(rows, 1, 1)[found // k % k] if len(rows) < len(found) else np.roll(rows[found // k % k], 1, 1)
    out *= rows[found % k]
    return out.astype(np.float32)


def _bundles(texts: list[str], letters: _Letters, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the trigram vectors, number of distinct trigrams) of ``n`` rows; text i belongs to ``row[i]``."""
    doc, code, found, of = _codes(texts, letters)
    total, distinct = np.zeros((n, DIM)), np.zeros(n, np.int64)
    block = min(BLOCK, max(256, CELLS // max(n, 1)))
    own = row[doc]
    if len(found) > block:
        order = np.argsort(code, kind="stable")
        own, code = own[order], code[order]
    for a in range(0, len(found), block):
        size = min(block, len(found) - a)
        i, j = (0, len(code)) if len(found) <= block else np.searchsorted(code, [a, a + size])
        counts = np.bincount(own[i:j].astype(np.int64) * size + code[i:j] - a, minlength=n * size).reshape(n, size)
        total += counts.astype(np.float32) @ _vectors(found[a:a + size], of)
        distinct += (counts > 0).sum(1)
    return total, distinct


def _slices(text: str) -> Iterator[str]:
    """Slices of about ``PIECE`` characters that end before a character that is no letter; a longer word is cut."""
    at = 0
    while len(text) - at > PIECE:
        end = next((i for i in range(at + PIECE, max(at + PIECE // 2, at + 1), -1) if not text[i].isalpha()), at + PIECE)
        yield text[at:end]
        at = end
    yield text[at:]


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """(first row, rows, texts, row of each text from the first): a very long text comes alone, slice by slice."""
    _, off = bytescan.flat(batch.column(column))
    for a, b in bytescan.pieces(off, PIECE):
        texts = [t or "" for t in batch.column(column).slice(a, b - a).to_pylist()]
        if b - a > 1 or len(texts[0]) <= 2 * PIECE:
            yield a, b - a, texts, np.arange(b - a)
        else:
            for part in _slices(texts[0]):
                yield a, 1, [part], np.zeros(1, np.int64)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, sums = _Letters(), {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, n, texts, row in _pieces(batch, 1):
            names = sorted(set(langs[a:a + n]))
            which = np.array([names.index(x) for x in langs[a:a + n]], np.int64)
            bundle, distinct = _bundles(texts, letters, which[row], len(names))
            for name, x, some in zip(names, bundle, distinct):
                if some:
                    sums[name] = sums.get(name, 0) + np.rint(x).astype(np.int64)
    for name, row in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [name] * DIM, "i": np.arange(DIM, dtype=np.int32), "x": row},
                                         schema=arrow_schema("lang string, i int, x long"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the labels in ``docs``.  Rows without a label teach nothing; so do texts without a letter."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    sums = (scan(rows, _learn, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")))
    found = sorted((r["lang"], r["v"]) for r in sums.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct languages")
    v = np.array([x for _, x in found], np.float64).reshape(len(found), DIM)
    return Profiles([x for x, _ in found], (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, trigrams of every row: the language of the largest cosine, ties to the first in the
    alphabet.  With ``whole_rows`` the first column is ``row``, the whole input row, in place of the id.

    ``score`` is that cosine, at least 0, and ``trigrams`` the number of distinct letter trigrams (a very long text's slices
    count on their own).  A text that is null, empty or has no letter gives ``und`` and 0, and so does any text when no
    language was learned.  A null id stays null; repeated rows give repeated rows; a text of any length and any script is
    read whole, in bounded memory; an empty table gives no rows; other columns are not read.
    """
    languages, matrix = profiles.languages, profiles.vectors.T.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters()
        for batch in batches:
            bundle, distinct = np.zeros((batch.num_rows, DIM)), np.zeros(batch.num_rows, np.int64)
            for a, n, texts, row in _pieces(batch, 1):
                x, some = _bundles(texts, letters, row, n)
                bundle[a:a + n] += x
                distinct[a:a + n] += some
            has = (distinct > 0) & bool(languages)
            cosine = (bundle @ matrix) / np.maximum(np.linalg.norm(bundle, axis=1), 1e-9)[:, None] if languages else np.zeros((batch.num_rows, 1))
            best = cosine.argmax(1)
            names = [languages[i] if x else "und" for i, x in zip(best.tolist(), has.tolist())]
            score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(distinct)],
                                             names=[first, "lang_pred", "score", "trigrams"])

    first = "row" if whole_rows else "doc_id"
    rows = docs.select((F.struct("*") if whole_rows else F.col(id_col).cast("long")).alias(first), F.col(text_col).cast("string").alias("text"))
    return scan(rows, run, f"{first} {rows.schema[first].dataType.simpleString()}, lang_pred string, score double, trigrams long")
