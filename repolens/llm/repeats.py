"""Repeated windows of a corpus: what the two substring operators share.

A window (50 words, or 200 bytes) is found through its minimiser, the k units in it whose fingerprint is smallest: equal
windows have equal minimisers at the same place.  Consecutive windows that share a minimiser form a run (a super-k-mer).
Runs are known by (key, cls): the minimiser's fingerprint and that of the whole run.

- Only runs whose key occurs elsewhere can hold a repeated window; the others end after one count by key.
- Runs of equal content are a class, settled from the class alone, however many copies there are.
- Where a key has several classes, one packed string per class goes to the key's bucket, and its windows are sorted and
  compared with the other classes' windows.  A key of more than ``MOST_CLASSES`` classes is dealt to parts of that many;
  each part sorts its windows' fingerprints and deals them, packed, to as many ranges, where the parts' windows meet.
- Texts are shuffled once, compressed, for the strings and for the cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import arrow_schema, pack, scan, unpack

MOST_CLASSES = 1024
SLICE = 1 << 20  # units of a long document whose windows are looked at together

_RUNS = "key long, cls long, doc_id long, tag int, at long, n int"
_PACKED = "key long, cls long, doc long, salt int, salts int, string binary"
_PLACES = "key long, cls long, place int, count int"


class Words:
    """Windows of 50 words, minimisers of 12."""
    width, k = 50, 12

    @staticmethod
    def hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(off) == 2 and off[-1] > 2 * bytescan.PIECE:
            parts = [Words.hashes(data[a:b], np.array([0, b - a]))[0] for a, b in bytescan.cuts(data, 0, int(off[-1]))]
            h = np.concatenate(parts)
            return h, np.array([0, len(h)])
        starts, ends, first = bytescan.words(data, off)
        return bytescan.span_hashes(data, starts, ends), first

    @staticmethod
    def prints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return bytescan.ladder(h, 12), bytescan.ladder(h, 50)

    @staticmethod
    def units(raw: bytes):
        return raw.split()  # the six separators, as ``bytescan.IS_SEP``

    @staticmethod
    def pack(units, a: int, b: int) -> bytes:
        return b" ".join(units[a:b])

    @staticmethod
    def windows(string: bytes, width: int) -> list[bytes]:
        gaps = np.flatnonzero(np.frombuffer(string, np.uint8) == 32)
        begin = np.concatenate([[0], gaps + 1]).tolist()
        end = np.concatenate([gaps, [len(string)]]).tolist()
        return [string[begin[i]:end[i + width - 1]] for i in range(len(begin) - width + 1)]


class Bytes:
    """Windows of 200 bytes, minimisers of 32."""
    width, k = 200, 32

    @staticmethod
    def hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data, off

    @staticmethod
    def prints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eight = bytescan.bytes_hashes(h)
        kmers = bytescan.ladder(eight, 32, 8)
        if len(h) < 200:
            return kmers, kmers[:0]
        return kmers, bytescan.join(bytescan.ladder(kmers, 192, 32)[:len(h) - 199], eight[192:])

    @staticmethod
    def units(raw: bytes):
        return raw

    @staticmethod
    def pack(units, a: int, b: int) -> bytes:
        return units[a:b]

    @staticmethod
    def windows(string: bytes, width: int) -> list[bytes]:
        return [string[i:i + width] for i in range(len(string) - width + 1)]


def tag(text: Column) -> Column:
    """Tells apart rows that share an id but not their text."""
    return F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int")


def runs(docs: DataFrame, unit) -> DataFrame:
    """The runs of every row of (doc_id, text); at is the first window's unit, n the number of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_RUNS)
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, off = bytescan.flat(batch.column(2))
            for a, b in bytescan.pieces(off):
                h, first = unit.hashes(data[off[a]:off[b]], off[a:b + 1] - off[a])
                step = SLICE if b - a == 1 else max(len(h), 1)
                for lo in range(0, max(len(h) - unit.width + 1, 0), step):
                    part = h[lo:lo + step + unit.width - 1]
                    own = first if b - a > 1 else np.array([0, len(part)])
                    doc, at, n, key, cls = bytescan.super_kmers(*unit.prints(part), own, unit.width, unit.k)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls.view(np.int64)), pa.array(ids[a:b][doc]),
                                                          pa.array(tags[a:b][doc]), pa.array(at + lo), pa.array(n.astype(np.int32))], schema=schema)

    return scan(docs.where("doc_id is not null and text is not null").select("doc_id", tag(F.col("text")).alias("tag"), "text"), run, _RUNS)


def zipped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(other, doc_id, tag, z): the rows by document, the text compressed, all other columns in one."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("other"), F.col(id_col).cast("long").alias("doc_id"),
                       tag(F.col(text_col).cast("string")).alias("tag"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [pack(t.as_buffer().to_pybytes()) if t.is_valid else None for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())], names=["other", "doc_id", "tag", "z"])
    return scan(rows, run, f"other {rows.schema['other'].dataType.simpleString()}, doc_id long, tag int, z binary").repartition("doc_id")


def packed(texts: DataFrame, wanted: DataFrame, unit) -> DataFrame:
    """The strings of the classes in ``wanted`` (key, cls, doc_id, tag, at, n, classes), cut from ``texts`` (``zipped``).
    A crowded key's classes are dealt to ``salts`` parts."""
    salts = F.ceil(F.col("classes") / MOST_CLASSES).cast("int")
    per_doc = wanted.groupBy(F.col("doc_id").alias("of"), F.col("tag").alias("as")).agg(
        F.collect_list(F.struct("key", "cls", "at", "n", F.pmod(F.xxhash64("cls"), salts).cast("int").alias("salt"), salts.alias("salts"))).alias("runs"))
    rows = texts.join(per_doc, (F.col("doc_id") == F.col("of")) & (F.col("tag") == F.col("as"))).select("doc_id", "z", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_PACKED)
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                doc, units = batch.column(0)[i].as_py(), unit.units(unpack(batch.column(1)[i].as_py()))
                for r in batch.column(2)[i].as_py():
                    string = unit.pack(units, r["at"], r["at"] + r["n"] + unit.width - 1)
                    out.append((r["key"], r["cls"], doc, r["salt"], r["salts"], string))
                    size += len(string) + 64
                if out and (size > 1 << 22 or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, size = [], 0
    return scan(rows, run, _PACKED)


def _islands(places) -> list[tuple[int, int]]:
    """(first, count) of the runs of consecutive numbers."""
    p = np.unique(np.asarray(places, np.int64))
    b = np.flatnonzero(np.diff(p, prepend=-2) != 1)
    return [(int(p[i]), int(j - i)) for i, j in zip(b, [*b[1:], len(p)])]


def _window_prints(string: bytes, unit) -> np.ndarray:
    raw = np.frombuffer(string, np.uint8)
    return unit.prints(unit.hashes(raw, np.array([0, len(raw)]))[0])[1]


def _least(w: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows, sorted, with their smallest document and how often they occur."""
    order = np.lexsort((doc, w))
    w, doc, n = w[order], doc[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, int)
    return w[at], doc[at], np.add.reduceat(n, at) if len(at) else n


def _crowded(strings: DataFrame, unit, ranked: bool) -> DataFrame:
    """``compare`` for keys whose classes come in several parts."""
    parts = strings.where("salts > 1").repartition("key", "salt")

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        prints = [_window_prints(x, unit) for x in group["string"]]
        sizes = [len(x) for x in prints]
        w, doc, n = _least(np.concatenate(prints), np.repeat(group["doc"].to_numpy(np.int64), sizes), np.ones(sum(sizes), np.int64))
        salts, key, salt = (int(group[c].iloc[0]) for c in ("salts", "key", "salt"))
        bucket = (w % np.uint64(salts)).astype(np.int64)
        rows = [(key, b, salt, w[bucket == b].tobytes(), doc[bucket == b].tobytes(), n[bucket == b].tobytes()) for b in range(salts)]
        return pd.DataFrame([r for r in rows if r[3]], columns=["key", "bucket", "salt", "w", "docs", "n"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.uint64) for x in group["w"]]
        w, doc, n = _least(np.concatenate(own), np.concatenate([np.frombuffer(x, np.int64) for x in group["docs"]]),
                           np.concatenate([np.frombuffer(x, np.int64) for x in group["n"]]))
        w, doc = w[n > 1], doc[n > 1]
        rows = []
        for salt, mine in zip(group["salt"], own):
            hit = np.isin(w, mine)
            if hit.any():
                rows.append((int(group["key"].iloc[0]), int(salt), w[hit].tobytes(), doc[hit].tobytes()))
        return pd.DataFrame(rows, columns=["k", "s", "w", "docs"])

    def settle(group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(group) and len(shared):
            w = np.concatenate([np.frombuffer(x, np.uint64) for x in shared["w"]])
            doc = np.concatenate([np.frombuffer(x, np.int64) for x in shared["docs"]])
            order = np.argsort(w)
            w, doc = w[order], doc[order]
            for key, cls, mine, string in group[["key", "cls", "doc", "string"]].itertuples(index=False, name=None):
                p = _window_prints(string, unit)
                at = np.minimum(np.searchsorted(w, p), len(w) - 1)
                hit = (w[at] == p) & ((doc[at] < mine) if ranked else True)
                rows += [(key, cls, a, n) for a, n in _islands(np.flatnonzero(hit))]
        return pd.DataFrame(rows, columns=["key", "cls", "place", "count"])

    packed_rows = parts.groupBy("key", "salt").applyInPandas(deal, "key long, bucket int, salt int, w binary, docs binary, n binary")
    shared = packed_rows.groupBy("key", "bucket").applyInPandas(meet, "k long, s int, w binary, docs binary")
    return parts.groupBy("key", "salt").cogroup(shared.groupBy("k", "s")).applyInPandas(settle, _PLACES)


def compare(strings: DataFrame, unit, ranked: bool) -> DataFrame:
    """(key, cls, place, count): the windows, by place in their run, that another class of the key has too; with ``ranked``
    only where that class belongs to a smaller document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_PLACES)
        rows = ((k, c, d, s) for b in batches for k, c, d, s in zip(*(x.to_pylist() for x in b.columns)))
        out = []
        for key, group in groupby(rows, itemgetter(0)):
            windows = [(w, doc, cls, i) for _, cls, doc, s in group for i, w in enumerate(unit.windows(s, unit.width))]
            windows.sort()
            hit: dict[int, list[int]] = {}
            for _, same in groupby(windows, itemgetter(0)):
                same = list(same)
                if len(same) > 1:
                    for _, doc, cls, i in same:
                        if not ranked or same[0][1] < doc:
                            hit.setdefault(cls, []).append(i)
            for cls, places in hit.items():
                out += [(key, cls, a, n) for a, n in _islands(places)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    few = strings.where("salts = 1").select("key", "cls", "doc", "string").repartition("key").sortWithinPartitions("key")
    return scan(few, run, _PLACES).unionAll(_crowded(strings, unit, ranked))


def cut(texts: DataFrame, columns: list[str], text_col: str, spans: DataFrame, kept_type: str,
        apply: Callable[[bytes, list[tuple[int, int]]], tuple]) -> DataFrame:
    """The rows of ``texts`` (``zipped``) with the fields of ``apply(text, merged spans)``: kept, n_units, n_removed, n_spans."""
    per_doc = spans.groupBy(F.col("doc_id").alias("of"), F.col("tag").alias("as")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))).alias("spans"))
    rows = texts.join(per_doc, (F.col("doc_id") == F.col("of")) & (F.col("tag") == F.col("as")), "left").select("other", "z", "spans")
    kind = pa.string() if kept_type == "string" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                z, found = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                merged: list[list[int]] = []
                for s in found or ():
                    if merged and s["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["b"])
                    else:
                        merged.append([s["a"], s["b"]])
                raw = None if z is None else unpack(z)
                out.append((raw, *apply(raw or b"", merged)))
            text, kept, *numbers = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()).cast(pa.string()), pa.array(kept, pa.binary()).cast(kind),
                                              *(pa.array(x, pa.int64()) for x in numbers)],
                                             names=["other", "text", "kept", "n_units", "n_removed", "n_spans"])

    shape = f"other {texts.schema['other'].dataType.simpleString()}, text string, kept {kept_type}, n_units long, n_removed long, n_spans long"
    row = F.struct(*[(F.col("text") if c == text_col else F.col("other").getField(c)).alias(c) for c in columns])
    return scan(rows, run, shape).select(row.alias("row"), "kept", "n_units", "n_removed", "n_spans")
