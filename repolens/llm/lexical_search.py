"""Ranked lexical search by best-first document intervals over range-maximum tables.

1. The items' terms are the vocabulary.  A scan of the documents keeps of each its length in terms and the vocabulary terms
   it holds, with their numbers; a scan of that gives the corpus statistics and with them each term's weight.
2. Documents are gathered into shards of about ``SHARD`` postings, in order of their ids.  A shard has a posting list per
   term, each posting with its impact on the score, and over the lists a sparse table: the place of the largest impact of
   every run of 2 ** j postings.  Two overlapping runs answer any range.
3. An interval of documents is bounded by the sum of the terms' largest impacts in it.  The intervals with the largest
   bounds are taken first and split at the document of the largest impact, which is scored on the way.  An interval of up to
   ``LEAF`` documents is scored whole.  An interval goes when its bound is below the k-th best score so far, or equals it
   and holds only larger ids.
4. A sample of the shards is searched first.  Its k-th best scores are lower bounds for the other shards.

Items come in blocks with at most about ``MOST_TERMS`` terms together, so what a task holds of them is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import arrow_schema, scan, written

MOST_TERMS = 1 << 20
SHARD = 1 << 20
LEAF = 16
LOOKUPS = 1 << 19  # of one step: terms of the item times intervals
SAMPLE = 16  # one of so many parts of the documents is searched first

#: What separates terms: all of ASCII but digits and letters.
SEPARATES = np.zeros(256, bool)
SEPARATES[:0x80] = True
for _first, _last in ("09", "AZ", "az"):
    SEPARATES[ord(_first):ord(_last) + 1] = False

_TERMS = "item_id long, term long"
_HITS = "doc_id long, n long, part int, terms binary, times binary"
_COUNTS = "term long, n long"
_FOUND = "item_id long, doc_id long, score long"
_NO_ID = np.iinfo(np.int64).max


def _hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, fingerprints of the terms, first term of each row); a very long text comes in several parts."""
    data, off = bytescan.flat(column)
    for a, b in bytescan.pieces(off):
        for lo, hi in bytescan.cuts(data, int(off[a]), int(off[b])) if b - a == 1 else [(int(off[a]), int(off[b]))]:
            own = bytescan.LOWER[data[lo:hi]]
            starts, ends, first = bytescan.words(own, off[a:b + 1] - lo if b - a > 1 else np.array([0, hi - lo]), SEPARATES)
            yield a, b - a, bytescan.span_hashes(own, starts, ends), first


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for a, n, h, first in _hashes(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:a + n], np.diff(first))), pa.array(h.view(np.int64))], schema=arrow_schema(_TERMS))


def _hits(vocabulary: np.ndarray):
    """doc_id, length, and the places in the sorted vocabulary with their counts; documents without any term are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(vocabulary)
        for batch in batches:
            length = np.zeros(batch.num_rows, np.int64)
            keys, times = [], []
            for a, n, h, first in _hashes(batch.column(1)):
                length[a:a + n] += np.diff(first)
                at = np.minimum(np.searchsorted(vocabulary, h), v - 1)
                hit = np.flatnonzero(vocabulary[at] == h)
                key, count = np.unique((np.searchsorted(first, hit, "right") - 1 + a) * v + at[hit], return_counts=True)
                keys.append(key)
                times.append(count)
            if not keys:
                continue
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, back, np.concatenate(times))
            edges = np.searchsorted(key, np.arange(batch.num_rows + 1) * v)
            term, count = (key % v).astype(np.int32), np.minimum(count, np.iinfo(np.int32).max).astype(np.int32)
            some = np.flatnonzero(length)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(length[some]), batch.column(2).take(pa.array(some)),
                 *(pa.array([x[edges[i]:edges[i + 1]].tobytes() for i in some], pa.binary()) for x in (term, count))], schema=arrow_schema(_HITS))
    return run


def _statistics(v: int):
    """Documents per term; under -1 the number of documents, under -2 that of their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = np.zeros(v, np.int64), 0, 0
        for batch in batches:
            docs += batch.num_rows
            terms += int(batch.column(0).to_numpy().sum())
            df += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32), minlength=v)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [docs, terms]]))],
                                         schema=arrow_schema(_COUNTS))
    return run


class Shard:
    """Posting lists of some documents, the sparse table over them, and the search."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, docs: int, terms: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.size = ids[order], len(ids)
        m = 10 + 90 * length * docs // max(terms, 1)
        tf = times.astype(np.int64)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        key = term.astype(np.int64) * self.size + place[doc]
        some = np.flatnonzero(impact > 0)
        some = some[np.argsort(key[some])]
        self.key, self.impact = key[some], impact[some]
        self.doc = (self.key % max(self.size, 1)).astype(np.int64)
        longest = int(np.max(np.bincount(self.key // self.size), initial=0)) if len(some) else 0
        self.table = [np.arange(len(some), dtype=np.int32)]
        for j in range(1, longest.bit_length()):
            half, last = 1 << j - 1, self.table[-1]
            a, b = last[:len(last) - half], last[half:]
            self.table.append(np.where(self.impact[a] >= self.impact[b], a, b))

    def _largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and impact of the largest posting of each range; impact 0 for an empty one."""
        place, n = np.zeros(lo.shape, np.int64), hi - lo
        level = np.frexp(n)[1] - 1
        for j in np.unique(level[n > 0]):
            at = np.nonzero((level == j) & (n > 0))
            a, b = self.table[j][lo[at]], self.table[j][hi[at] - (1 << int(j))]
            place[at] = np.where(self.impact[a] >= self.impact[b], a, b)
        return place, np.where(n > 0, self.impact[place], 0)

    def _bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound and splitting document of intervals, from their terms' posting ranges [term, interval]."""
        place, largest = self._largest(lo, hi)
        top = np.argmax(largest, 0)
        return largest.sum(0), self.doc[place[top, np.arange(lo.shape[1])]]

    def _scored(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a posting in the ranges [term, interval], and their scores."""
        lo, n = lo.ravel(), (hi - lo).ravel()
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        docs, back = np.unique(self.doc[at], return_inverse=True)
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, back, self.impact[at])
        return docs, total

    def search(self, terms: np.ndarray, k: int, least: int = 0, least_id: int = _NO_ID) -> list[tuple[int, int]]:
        """(score, place) of the k best documents, those worse than (``least``, ``least_id``) not needed."""
        if not len(self.key):
            return []
        base = terms.astype(np.int64) * self.size
        at = lambda docs: np.searchsorted(self.key, base[:, None] + docs[None, :])
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = np.array([0]), np.array([self.size])
        bound, split = self._bounds(at(lo), at(hi))
        many = 8
        while True:
            # The k-th best so far, or what the caller knows.
            floor, floor_id = (least, least_id) if len(scores) < k else max((least, -least_id), (int(scores[-1]), -int(self.ids[docs[-1]])))
            if len(scores) >= k:
                floor_id = -floor_id
            alive = (bound > 0) & ((bound > floor) | ((bound == floor) & (self.ids[lo] <= floor_id)))
            lo, hi, bound, split = lo[alive], hi[alive], bound[alive], split[alive]
            if not len(lo):
                return [(int(s), int(d)) for s, d in zip(scores, docs)]
            take = np.zeros(len(lo), bool)
            take[np.lexsort((lo, -bound))[:max(1, min(many, LOOKUPS // len(terms)))]] = True
            many *= 2
            leaf, inner = take & (hi - lo <= LEAF), take & (hi - lo > LEAF)
            found = [(docs, scores)]
            if leaf.any():
                found.append(self._scored(at(lo[leaf]), at(hi[leaf])))
            new = []
            if inner.any():
                l, s, h = lo[inner], split[inner], hi[inner]
                pl, ps, ph = at(l), at(s), at(h)
                safe = np.minimum(ps, len(self.key) - 1)
                here = (ps < ph) & (self.doc[safe] == s[None, :])
                found.append((s, np.where(here, self.impact[safe], 0).sum(0)))
                for a, b, pa_, pb in ((l, s, pl, ps), (s + 1, h, ps + here, ph)):
                    some = np.flatnonzero(a < b)
                    new.append((a[some], b[some], *self._bounds(pa_[:, some], pb[:, some])))
            lo, hi, bound, split = (np.concatenate([old[~take], *(x[i] for x in new)]) for i, old in enumerate((lo, hi, bound, split)))
            docs, scores = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            best = np.lexsort((docs, -scores))[:k]  # places are in the order of the ids
            best = best[scores[best] > 0]
            docs, scores = docs[best], scores[best]


def _search(items: list[tuple[int, np.ndarray]], weight: np.ndarray, docs: int, terms: int, k: int, least: dict[int, tuple[int, int]]):
    def found(rows: list[tuple], ids: list) -> Iterator[pa.RecordBatch]:
        size = [len(r[1]) // 4 for r in rows]
        term, times = (np.frombuffer(b"".join(r[i] for r in rows), np.int32) for i in (1, 2))
        own = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        shard = Shard(own, np.array([r[0] for r in rows], np.int64), np.repeat(np.arange(len(rows)), size), term, times, weight, docs, terms)
        out = []
        for item, wanted in items:
            for score, place in shard.search(wanted, k, *least.get(item, (0, _NO_ID))):
                out.append((item, None if shard.ids[place] == _NO_ID else int(shard.ids[place]), score))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, arrow_schema(_FOUND).types)],
                                         schema=arrow_schema(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, postings = [], [], 0
        for batch in batches:
            for i, *row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                ids.append(i)
                postings += len(row[1]) // 4 + 1
                if postings >= SHARD:
                    yield from found(rows, ids)
                    rows, ids, postings = [], [], 0
        if rows:
            yield from found(rows, ids)
    return run


def _block(docs: DataFrame, items: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """The k best documents of each of the items (item_id, term fingerprints)."""
    vocabulary = np.unique(np.concatenate([t for _, t in items])) if items else np.zeros(1, np.uint64)
    items = [(i, np.searchsorted(vocabulary, t)) for i, t in items]
    part = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(SAMPLE)).cast("int")
    hits = written(scan(docs.select("doc_id", "text", part.alias("part")), _hits(vocabulary), _HITS), "term_hits")
    counts = {r["term"]: r["n"] for r in scan(hits.select("n", "terms"), _statistics(len(vocabulary)), _COUNTS)
              .groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per term of the vocabulary
    n, total = counts.get(-1, 0), counts.get(-2, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def ranked(part: DataFrame, least: dict) -> DataFrame:
        found = scan(part.select("doc_id", "n", "terms", "times"), _search(items, weight, n, total, k, least), _FOUND)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written(ranked(hits.where("part = 0"), {}), "found_first")
    # A pair of numbers per item of the block.
    least = {r["item_id"]: (r["score"], _NO_ID if r["doc_id"] is None else r["doc_id"]) for r in first.where(F.col("rank") == k).collect()}
    rest = ranked(hits.where("part <> 0"), least)
    return first.drop("rank").unionAll(rest.drop("rank")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` highest-scoring documents with a score above 0.

    Terms are runs of digits, ASCII letters and all characters beyond ASCII, A-Z in lower case.  The score sums, over an
    item's distinct terms, weight * (10^9 tf div (1000 tf + 8 m)), in whole numbers; m grows with the document's length.
    Equal scores go by ascending id, null ids last.  With fewer documents above 0 all are returned.

    Null, empty and termless texts match nothing and don't count in the statistics; a text of any length is read whole.
    Rows that repeat an id or a text are documents each.  Items of one id are one item with the terms of all its rows; items
    with a null id take no part.  Without documents or items there are no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = (items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
              .where("item_id is not null and text is not null"))
    wanted = written(scan(wanted, _item_terms, _TERMS).distinct(), "item_terms")
    blocks = max(1, -(-wanted.count() // MOST_TERMS))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long, rank int")
    for b in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        ids, terms = own["item_id"].to_numpy(), own["term"].to_numpy().view(np.uint64)
        order = np.lexsort((terms, ids))
        each, at = np.unique(ids[order], return_index=True)
        out = out.unionAll(_block(docs, list(zip(each.tolist(), np.split(terms[order], at[1:]))), k).select(out.columns))
    return out.select("item_id", "rank", "doc_id", "score")
