"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE`` words; all of its text takes part.  A passage is encoded from hashed counts
of its words and of its words' shapes (first and last character, length), and of immediate repeats, through one tanh layer.  Gated attention
weighs the passages: a_i ~ exp(w . (tanh(V h_i) * sigmoid(U h_i))), and the score is the logistic function of the weighted
sum of the h_i.  Only document labels are known, so encoder, gate and output are learned together from them.

Learning takes a bounded sample (``most_rows`` labelled documents, the first by a hash of their id, none of more than
``most_passages`` passages, ``most_total`` passages in all); encoding and scoring run where the rows lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import arrow_schema, scan

PASSAGE = 50
WORDS, SHAPES = 256, 256
DIM = WORDS + SHAPES + 2  # the last two: words that repeat the one before them, words that don't

_KIND = np.arange(256, dtype=np.int64)  # of a byte; punctuation keeps its own
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[0x80:] = 1


def _encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of each passage, its document) for the documents of one piece; without a word a text is one empty passage."""
    starts, ends, first = bytescan.words(data, off)
    n = len(off) - 1
    per_doc = np.diff(first)
    passages = np.maximum(1, -(-per_doc // PASSAGE))
    base = np.concatenate([[0], np.cumsum(passages)])
    doc = np.repeat(np.arange(n), per_doc)
    which = base[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    word = bytescan.span_hashes(bytescan.LOWER[data], starts, ends)
    shape = (_KIND[data[starts]] * 256 + _KIND[data[ends - 1]]) * 16 + np.minimum(ends - starts, 15) if len(starts) else starts
    shape = bytescan.mix(shape.astype(np.uint64) + np.uint64(1))
    again = np.zeros(len(starts), np.int64)
    again[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    total = int(base[-1])
    counts = np.bincount(which * DIM + (word % np.uint64(WORDS)).astype(np.int64), minlength=total * DIM)
    counts += np.bincount(which * DIM + WORDS + (shape % np.uint64(SHAPES)).astype(np.int64), minlength=total * DIM)
    counts += np.bincount(which * DIM + DIM - 2 + again, minlength=total * DIM)
    return counts.reshape(total, DIM).astype(np.uint8), np.repeat(np.arange(n), passages)


def _bags(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, counts, row of each passage) by pieces; a very long text comes in several pieces of its own."""
    data, off = bytescan.flat(batch.column(column))
    for a, b in bytescan.pieces(off):
        if b - a > 1 or off[b] - off[a] <= 2 * bytescan.PIECE:
            yield (a, b - a, *_encode(data[off[a]:off[b]], off[a:b + 1] - off[a]))
        else:
            for lo, hi in bytescan.cuts(data, int(off[a]), int(off[b])):
                yield (a, 1, *_encode(data[lo:hi], np.array([0, hi - lo])))


def _features(counts: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32)
    return np.sqrt(x / np.maximum(x[:, :WORDS].sum(1, keepdims=True), 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """The encoder, the gated attention and the output layer."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        shape = {"W": (DIM, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "c0": ()}
        self.p = {k: (rng.standard_normal(s) / np.sqrt(max(s[0] if s else 1, 1))).astype(np.float32) if k not in ("b", "c0")
                  else np.zeros(s, np.float32) for k, s in shape.items()}

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representation and attention logit of each passage."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        return h, (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4) -> None:
        """Adam on the log loss.  ``bag`` is the document of each passage, in order."""
        p = self.p
        m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        edges = np.searchsorted(bag, np.arange(len(y) + 1))
        rng = np.random.default_rng(5)
        for _ in range(epochs if len(y) else 0):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                docs = order[i:i + batch]
                take = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in docs])
                size = edges[docs + 1] - edges[docs]
                seg, begin = np.repeat(np.arange(len(docs)), size), np.concatenate([[0], np.cumsum(size)[:-1]])
                xb = _features(x[take])
                h = np.tanh(xb @ p["W"] + p["b"])
                tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
                e = (tv * su) @ p["w"]
                a = np.exp(e - np.maximum.reduceat(e, begin)[seg])
                a /= np.add.reduceat(a, begin)[seg]
                z = np.add.reduceat(h * a[:, None], begin)
                err = (_sigmoid(z @ p["c"] + p["c0"]) - y[docs]) / len(docs)
                dz = err[:, None] * p["c"]
                da = (dz[seg] * h).sum(1)
                de = a * (da - np.add.reduceat(a * da, begin)[seg])
                dgate = de[:, None] * p["w"]
                dv, du = dgate * su * (1 - tv ** 2), dgate * tv * su * (1 - su)
                dh = (dz[seg] * a[:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - h ** 2)
                g = {"W": xb.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (tv * su).T @ de, "c": z.T @ err, "c0": err.sum()}
                t += 1
                for k in p:
                    d = g[k] + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        most_rows: int = 4096, most_passages: int = 512, most_total: int = 1 << 18, hash_seed: str = "quality") -> Model:
    """Learn from at most ``most_rows`` labelled documents, the first by a hash of their id, of at most ``most_passages``
    passages each and ``most_total`` together; a longer document is left out whole.  A null label or id teaches nothing;
    rows that repeat id and text are one document, and several texts of an id are documents each."""
    rank = [F.xxhash64("doc_id", F.lit(hash_seed)), "doc_id", "y"]
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
              .where("doc_id is not null and y in (0, 1)").orderBy(*rank).limit(most_rows))
    text = F.col(text_col).cast("string")
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
            .join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", F.xxhash64("text").alias("key")))  # most_rows rows of two numbers
    # The bound holds for the documents that are found: an id can stand on any number of texts.
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    sizes = (rows.select("doc_id", "y", "key", F.ceil(F.greatest(words, F.lit(1)) / PASSAGE).alias("n")).where(F.col("n") <= most_passages)
             .distinct().orderBy(*rank, "key").limit(most_rows).collect())
    total = np.cumsum([r["n"] for r in sizes])
    within = [(r["doc_id"], r["y"], r["key"]) for r, n in zip(sizes, total) if n <= most_total]
    wanted = docs.sparkSession.createDataFrame(within, "doc_id long, y int, key long")
    rows = (rows.join(F.broadcast(wanted), ["doc_id", "y", "key"]).groupBy("doc_id", "y", "key").agg(F.first("text").alias("text"))
            .select("doc_id", "y", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, n, counts, doc in _bags(batch, 2):
                edges = np.searchsorted(doc, np.arange(n + 1))
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a:a + n], "y": ys[a:a + n], "n": np.diff(edges).astype(np.int32),
                                                  "x": [counts[i:j].tobytes() for i, j in zip(edges, edges[1:])]},
                                                 schema=arrow_schema("doc_id long, y int, n int, x binary"))

    bags = scan(rows, run, "doc_id long, y int, n int, x binary")
    found = sorted(bags.collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([r["y"] for r in found], np.float32)
    bag = np.repeat(np.arange(len(found)), [r["n"] for r in found])
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.uint8).reshape(-1, DIM)
    model = Model()
    model.fit(x, bag, y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and passages of every row of ``docs``.

    A text that is null, empty or has no word is one empty passage and gets that passage's score.  A null id stays null;
    repeated rows give repeated rows; a very long text is scored whole, in bounded memory; other columns are not read.
    """
    out = "doc_id long, score double, passages long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            top, weight, total = np.full(rows, -np.inf), np.zeros(rows), np.zeros((rows, len(model.p["c"])))
            count = np.zeros(rows, np.int64)
            for a, n, x, doc in _bags(batch, 1):
                h, e = model.passages(_features(x))
                begin = np.searchsorted(doc, np.arange(n))
                now = np.maximum(top[a:a + n], np.maximum.reduceat(e, begin))
                shrink = np.exp(top[a:a + n] - now)
                w = np.exp(e - now[doc])
                weight[a:a + n] = weight[a:a + n] * shrink + np.add.reduceat(w, begin)
                total[a:a + n] = total[a:a + n] * shrink[:, None] + np.add.reduceat(h * w[:, None], begin)
                top[a:a + n] = now
                count[a:a + n] += np.bincount(doc, minlength=n)
            z = total / weight[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(z @ model.p["c"] + model.p["c0"]).astype(np.float64)),
                                              pa.array(count)], schema=arrow_schema(out))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scan(rows, run, out)
