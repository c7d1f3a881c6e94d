"""Exact top-k search by inner product, with vectors grouped by length.

1. A first threshold per query: its k-th best score against the ``WARM`` longest vectors.  The k-th best of all is at
   least that.
2. Vectors fall into buckets of nearly equal length (a factor of ``RATIO``); a bucket of more than ``BLOCK`` vectors is
   dealt into blocks by a hash of the id, so that any number of equally long vectors spreads out.
3. A query goes to the blocks of the buckets that can still reach its threshold: |q| * (longest of the bucket) >= threshold.
4. Inside a block the threshold becomes a least cosine, threshold / (|q| * longest).  From ``COORDINATE`` up, the vectors
   are pruned by coordinate (a unit vector of that cosine has its coordinates within bounds that follow from the
   query's); below, by length.  What is left is multiplied out, and a bucket's k best go on.

A bound prunes only what lies strictly below the threshold, with a margin for rounding, so ties survive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, scan

WARM = 2048
BLOCK = 8192
QUERY_BLOCK = 1024
RATIO = 1.1
COORDINATE = 0.6
FOCUS = 3
_MARGIN = 1 + 1e-9

_HITS = "query_id long, vec_id long, score long"


def _matrix(vectors, scale: float, wide: int = 0) -> np.ndarray:
    """Whole numbers as doubles, a row per vector; shorter vectors end in zeros."""
    rows = [np.floor(scale * np.asarray(v, np.float64)) for v in vectors]
    out = np.zeros((len(rows), max([wide, *map(len, rows)])))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles hold whole numbers up to 2**53, and no partial sum exceeds |q| |v|."""
    d = min(q.shape[1], v.shape[1])  # what is beyond meets zeros
    q, v = q[:, :d], v[:, :d]
    if len(q) and len(v) and np.linalg.norm(q, axis=1).max() * np.linalg.norm(v, axis=1).max() >= 2.0 ** 52:
        return (np.vectorize(int, otypes=[object])(q) @ np.vectorize(int, otypes=[object])(v.T)).astype(np.int64)
    return np.rint(q @ v.T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _block(k: int, scale: float):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            v = _matrix(vectors["embedding"], scale)
            ids = vectors["vec_id"].to_numpy(np.int64)
            length = np.linalg.norm(v, axis=1)
            order = np.argsort(-length, kind="stable")
            v, ids, length = v[order], ids[order], length[order]
            unit = v / np.maximum(length, 1e-300)[:, None]
            q = _matrix(queries["embedding"], scale)
            qids, threshold = queries["query_id"].to_numpy(np.int64), queries["threshold"].to_numpy(np.float64)
            qlength = np.linalg.norm(q, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.where((qlength > 0) & (length[0] > 0) & (threshold > 0), threshold / (qlength * length[0]) / _MARGIN, -1.0)
                reach = np.where((threshold > 0) & (qlength > 0), threshold / qlength / _MARGIN, 0.0)
            by_length = np.flatnonzero((cosine < COORDINATE) | (cosine < 0))
            if len(by_length):
                n = int(np.searchsorted(-length, -reach[by_length].min(), "right"))
                for i, row in zip(by_length, _products(q[by_length], v[:n])):
                    use = np.flatnonzero((ids[:n] != qids[i]) & (row >= threshold[i]))
                    top = use[_best(row[use], ids[use], k)]
                    out.append((np.full(len(top), qids[i]), ids[top], row[top]))
            for i in np.flatnonzero((cosine >= max(COORDINATE, 0)) & (cosine <= 1)):
                n = int(np.searchsorted(-length, -reach[i], "right"))
                alive = ids[:n] != qids[i]
                d = min(v.shape[1], q.shape[1])
                mine = q[i, :d] / qlength[i]
                t = cosine[i]
                for f in np.argsort(-np.abs(mine))[:FOCUS]:
                    spread = math.sqrt(max(0.0, 1 - mine[f] ** 2) * max(0.0, 1 - t * t)) + 1e-9
                    low, high = mine[f] * t - spread, mine[f] * t + spread
                    if mine[f] >= t:  # the cone holds the axis itself
                        high = 1.0 + 1e-9
                    if -mine[f] >= t:
                        low = -1.0 - 1e-9
                    alive &= (unit[:n, f] >= low) & (unit[:n, f] <= high)
                use = np.flatnonzero(alive)
                row = _products(q[i:i + 1], v[use])[0] if len(use) else np.zeros(0, np.int64)
                use, row = use[row >= threshold[i]], row[row >= threshold[i]]
                top = _best(row, ids[use], k)
                out.append((np.full(len(top), qids[i]), ids[use][top], row[top]))
        cols = [np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in range(3)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))
    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest inner products of the vectors floor(scale * x).

    ``is_query`` is a condition on ``vec_id``.  Candidates are all rows of another id; ties go to the smaller id; with fewer
    than ``k`` all are returned.  Rows whose id or vector is null, or whose vector holds a null, NaN or infinity, take no
    part; an empty vector scores 0 with all, and a shorter vector ends in zeros.  Rows that repeat an id are candidates
    each, but one query, the least of them.  Scores must fit into 64 bits.  Other columns are not read.
    """
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
            .where("vec_id is not null and embedding is not null")
            .where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
            .withColumn("length", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + whole(x) * whole(x)))))
    rows = rows.withColumn("bucket", F.when(F.col("length") > 0, F.floor(F.log("length") / math.log(RATIO)).cast("int")).otherwise(-1))
    # One row per length bucket; doubles have some 15,000 such lengths at most.
    buckets = [(r["bucket"], -(-r["n"] // BLOCK), r["longest"]) for r in
               rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("bucket").collect()]
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    nq = max(1, -(-rows.where(is_query).count() // QUERY_BLOCK))
    warm = rows.orderBy(F.desc("length"), "vec_id").limit(WARM).select("vec_id", "embedding").collect()
    warm_ids = np.array([r["vec_id"] for r in warm], np.int64)
    warm_rows = _matrix([r["embedding"] for r in warm], scale)

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            q = _matrix(batch.column(1).to_pylist(), scale)
            scores = _products(q, warm_rows).astype(np.float64) if len(q) else np.zeros((0, len(warm_ids)))
            scores[ids[:, None] == warm_ids[None, :]] = -np.inf
            kth = np.partition(scores, -k, 1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.linalg.norm(q, axis=1)), pa.array(kth)],
                                             names=["query_id", "embedding", "qlength", "threshold"])

    asked = scan(queries.select("vec_id", "embedding"), thresholds, "query_id long, embedding array<double>, qlength double, threshold double")
    table = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("blocks"), F.lit(x).alias("longest")) for b, n, x in buckets]) \
        if buckets else F.expr("cast(array() as array<struct<bucket:int,blocks:int,longest:double>>)")
    spread = (asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int"))
              .withColumn("t", F.explode(F.filter(table, lambda b: F.col("threshold") <= F.col("qlength") * b["longest"] * _MARGIN)))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("t.blocks") - 1)))
              .select("part", F.col("t.bucket").alias("bucket"), "block", "query_id", "embedding", "threshold"))
    blocks = F.element_at(F.map_from_entries(F.transform(table, lambda b: F.struct(b["bucket"], b["blocks"]))), F.col("bucket")) if buckets else F.lit(1)
    dealt = (rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
             .select(F.col("part").alias("p"), F.col("bucket").alias("u"), F.col("block").alias("b"), "vec_id", "embedding"))
    hits = (spread.groupBy("part", "bucket", "block").cogroup(dealt.groupBy("p", "u", "b")).applyInPandas(_block(k, scale), _HITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
