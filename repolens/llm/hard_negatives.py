"""Hard-negative mining with Four-Russians scoring of bit-plane vectors.

Components become whole numbers.  A candidate is packed into bit planes: for each plane and each group of eight dimensions
one byte, in two's complement, the highest plane counted negative.  For each group an anchor has a table of the sums of all
256 subsets of its eight numbers, so a byte looks up what its plane and group add to the product.  From the highest plane
down, the sum so far is doubled and the next plane's lookups are added; the last sum is the full, exact score.

1. Candidates are packed where they lie and dealt to tiles of at most ``TILE`` by a hash; anchors to parts of at most
   ``TILE``.  A task holds one tile and one part, so memory is bounded and both sides are copied once per tile of the other.
2. First pass: each tile's best rows of the anchor's own label; over all tiles they give the positives.
3. Second pass: each tile's best rows of other labels inside the score window of each positive; over all tiles they give
   the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, scan, written

TILE = 1 << 15
ANCHORS = 64  # whose tables a task holds at once: 2,048 bytes a group and anchor
ROWS = 4096  # candidates that are looked up at once

_PACKED = "vec_id long, label int, depth int, planes binary"


def pack(numbers: np.ndarray) -> tuple[int, np.ndarray]:
    """(depth, planes) of a matrix of whole numbers: planes[row, plane, group], the lowest plane first."""
    rows, dims = numbers.shape
    groups = -(-dims // 8)
    wide = np.zeros((rows, groups * 8), np.int64)
    wide[:, :dims] = numbers
    high = int(np.max(np.where(wide < 0, ~wide, wide), initial=0))
    depth = high.bit_length() + 1
    planes = np.empty((rows, depth, groups), np.uint8)
    for j in range(depth):
        planes[:, j] = np.packbits((wide >> j & 1).astype(np.uint8), axis=1, bitorder="little")
    return depth, planes


def tables(anchors: np.ndarray, groups: int) -> np.ndarray:
    """Subset sums [group, byte, anchor] of the anchors' numbers; missing dimensions are zeros."""
    n, dims = anchors.shape
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :min(dims, groups * 8)] = anchors[:, :groups * 8]
    out = np.zeros((groups, 256, n), np.int64)
    for bit in range(8):  # the subsets with this bit are those without it, plus its number
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + wide[:, bit::8].T[:, None, :]
    return out


def scores(planes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Exact inner products [candidate, anchor] by lookups, shifts and additions, modulo 2 ** 64."""
    rows, depth, groups = planes.shape
    total = np.zeros((rows, table.shape[2]), np.int64)
    for j in range(depth - 1, -1, -1):
        if j == depth - 1:
            for g in range(groups):
                total -= table[g][planes[:, j, g]]
        else:
            total <<= 1
            for g in range(groups):
                total += table[g][planes[:, j, g]]
    return total


def _whole(vectors, scale: float) -> np.ndarray:
    rows = [np.floor(scale * np.asarray(v, np.float64)).astype(np.int64) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _packed(scale: float):
    """Candidates in bit planes, as deep as their own batch needs; vectors of one length of a batch together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            size = np.array([len(v) for v in vectors], np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                depth, planes = pack(_whole([vectors[i] for i in at], scale))
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.full(len(at), depth, np.int32)),
                                                  pa.array([p.tobytes() for p in planes], pa.binary())], schema=arrow_schema(_PACKED))
    return run


def _first(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
    return at[np.lexsort((ids[at], -row[at]))][:k]


def _blocks(candidates: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, planes) of candidates of one shape, some thousand at a time."""
    for (depth, size), same in candidates.groupby([candidates["depth"], candidates["planes"].map(len)], sort=True):
        for a in range(0, len(same), ROWS):
            some = same.iloc[a:a + ROWS]
            planes = np.frombuffer(b"".join(some["planes"]), np.uint8).reshape(len(some), depth, size // depth)
            yield some["vec_id"].to_numpy(np.int64), some["label"].to_numpy(np.int64), planes


def _positives(scale: float, k: int):
    """One tile's first k rows of the anchor's label, by label: only those are scored."""
    def run(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, mine in anchors.groupby("label") if len(anchors) and len(candidates) else ():
            for ids, _, planes in _blocks(candidates[candidates["label"] == label]):
                for a in range(0, len(mine), ANCHORS):
                    some = mine.iloc[a:a + ANCHORS]
                    found = scores(planes, tables(_whole(some["embedding"], scale), planes.shape[2])).T
                    for anchor, row in zip(some["anchor_id"], found):
                        other = np.flatnonzero(ids != anchor)
                        for i in other[_first(row[other], ids[other], k)]:
                            out.append((anchor, ids[i], row[i]))
        return pd.DataFrame(out, columns=["anchor_id", "vec_id", "score"], dtype="int64")
    return run


def _negatives(scale: float, k: int, low: int, high: int):
    """One tile's first k rows of other labels in the window of each of the anchor's positive scores."""
    def run(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, labels, planes in _blocks(candidates) if len(anchors) and len(candidates) else ():
            for a in range(0, len(anchors), ANCHORS):
                some = anchors.iloc[a:a + ANCHORS]
                found = scores(planes, tables(_whole(some["embedding"], scale), planes.shape[2])).T
                for anchor, label, wanted, row in zip(some["anchor_id"], some["label"], some["wanted"], found):
                    other = np.flatnonzero((labels != label) & (ids != anchor))
                    row, own = row[other], ids[other]
                    for positive in sorted(set(wanted)):
                        least, most = -(-low * int(positive) // 100), high * int(positive) // 100
                        use = np.flatnonzero((row >= least) & (row <= most))
                        for i in use[_first(row[use], own[use], k)]:
                            out.append((anchor, positive, own[i], row[i]))
        return pd.DataFrame(out, columns=["anchor_id", "positive_score", "vec_id", "score"], dtype="int64")
    return run


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of the vectors floor(scale * x), higher first, ties to the smaller id.  An anchor's positives
    are its first rows of the same label and another id; for each of them the negatives are the first rows of another label
    (and another id) with low * positive_score <= 100 * negative_score <= high * positive_score.  With fewer all are
    returned; a positive without any gives no row.  ``is_anchor`` is a condition on ``vec_id``.

    Rows whose id, label or vector is null, or whose vector holds a null, NaN or infinity, take no part.  An empty vector
    scores 0 with all, and a shorter vector ends in zeros.  Rows that repeat an id are candidates each, but one anchor, the
    least of them.  Numbers and scores must fit into 64 bits.  An empty table gives no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("embedding"))
            .where("vec_id is not null and label is not null and embedding is not null")
            .where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))))
    anchors = written(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("a"))
                      .select(F.col("vec_id").alias("anchor_id"), "a.label", "a.embedding"), "anchors")
    packed = written(scan(rows, _packed(scale), _PACKED), "bit_planes")
    # As many tiles as tasks, and more where a tile would be too large.
    tiles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-packed.count() // TILE))
    parts = max(1, -(-anchors.count() // TILE))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = (packed.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")).withColumn("part", each(parts))
             .groupBy("tile", "part"))
    asked = anchors.withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int"))
    grid = lambda a: a.withColumn("tile", each(tiles)).groupBy("tile", "part")

    near = grid(asked).cogroup(dealt).applyInPandas(_positives(scale, positives), "anchor_id long, vec_id long, score long")
    found = written(_ranked(near, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                    "positives")
    wanted = found.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("wanted"))  # at most ``positives`` each
    windows = grid(asked.join(wanted, "anchor_id")).cogroup(dealt).applyInPandas(
        _negatives(scale, negatives, low, high), "anchor_id long, positive_score long, vec_id long, score long")
    hard = _ranked(windows, ["anchor_id", "positive_score"], negatives)
    return (found.join(hard, ["anchor_id", "positive_score"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
