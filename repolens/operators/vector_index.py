"""Exact nearest neighbours over a stored index of cells.

The index is two tables below one path: ``vectors``, partitioned by cell, and
``cells`` (cell, n, radius, centroid).  Cells are the nearest centroids of a
k-means fit on a bounded sample; every vector is stored, whatever the sample.

Unit vectors of cosine s are sqrt(2 - 2 s) apart, and that distance keeps the
triangle inequality: no vector of a cell is nearer to a query than the
distance to the centroid less the cell's radius.  A search first reads the
cells nearest to each query, which gives it a k-th best distance, and then
only the cells whose bound does not exceed that.  Cells that no query needs
are partitions that the scan never opens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieve import _unit

# The fit's sample and rounds; vectors and queries that a task multiplies at once.
SAMPLE = 20_000
ROUNDS = 8
VECTOR_BLOCK = 16_384
QUERY_BLOCK = 4096
NO_DIRECTION = -1  # the cell of the zero vectors, whose cosine with anything is 0
_MARGIN = 1e-9


def fit_cells(vectors: DataFrame, cells: int, v_id: str = "vec_id", v_vec: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids, at most ``cells``, of at most ``sample`` vectors (the
    first by a hash of their id): spherical k-means, deterministic."""
    rows = (vectors.select(F.col(v_id).alias("i"), F.col(v_vec).cast("array<double>").alias("v"))
            .orderBy(F.xxhash64("i"), "i").limit(sample).select("v").collect())
    u = _unit([r["v"] for r in rows]) if rows else np.zeros((0, 1))
    u = u[np.abs(u).sum(1) > 0]
    if not len(u):
        return np.zeros((0, u.shape[1]))
    # Far-apart starts: each one the vector least like those before it.
    at, near = [0], u @ u[0]
    while len(at) < min(cells, len(u)) and near.min() < 1 - 1e-12:
        at.append(int(near.argmin()))
        near = np.maximum(near, u @ u[at[-1]])
    c = u[at]
    for _ in range(ROUNDS):
        own = (u @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, u)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], c)
    return c


def write_vector_index(vectors: DataFrame, path: str, cells: int = 64, v_id: str = "vec_id", v_vec: str = "embedding",
                       sample: int = SAMPLE) -> None:
    """Store ``vectors`` by cell, and the table of cells.  Rows without a vector are left out."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(v_id).alias("vec_id"), F.col(v_vec).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    centroids = fit_cells(rows, cells, "vec_id", "v", sample)

    def assign(batches):
        for pdf in batches:
            u = _unit(pdf["v"]) if len(pdf) else np.zeros((0, 1))
            sims = u @ centroids.T if len(centroids) and len(pdf) else np.zeros((len(pdf), 1))
            zero = np.abs(u).sum(1) == 0
            own = np.where(zero, NO_DIRECTION, sims.argmax(1))
            yield pdf.assign(cell=own.astype("int32"), far=np.sqrt(np.maximum(0.0, 2 - 2 * sims.max(1))))

    kind = dict(rows.dtypes)["vec_id"]
    (rows.mapInPandas(assign, f"vec_id {kind}, v array<double>, cell int, far double")
     .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors"))
    stored = spark.read.parquet(f"{path}/vectors")
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    (stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(known, "cell", "left")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/cells"))


class _Cells:
    """The table of cells in memory: as many rows as the fit was asked for, and one."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r["cell"])
        self.id = np.array([r["cell"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.zero = self.id == NO_DIRECTION
        self.radius = np.array([0.0 if r["cell"] == NO_DIRECTION else r["radius"] for r in rows])
        dims = max((len(r["centroid"]) for r in rows if r["centroid"]), default=1)
        self.centroid = np.array([r["centroid"] or [0.0] * dims for r in rows]).reshape(len(rows), dims)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """[query, cell]: no vector of the cell is nearer than this."""
        sims = np.zeros((len(q), len(self.id))) if self.zero.all() else q @ self.centroid.T
        far = np.sqrt(np.maximum(0.0, 2 - 2 * sims))
        low = np.maximum(0.0, far - self.radius[None, :] - _MARGIN)
        flat = np.abs(q).sum(1) == 0  # a zero query has cosine 0 with all vectors
        return np.where(self.zero[None, :] | flat[:, None], np.sqrt(2.0) - _MARGIN, low)


def _plan(cells: _Cells, k: int, first: bool):
    """(query_id, q, cell): the cells to read, the nearest that hold k vectors together, or all others within ``reach``."""
    def run(batches):
        for pdf in batches:
            low = cells.bounds(_unit(pdf["q"])) if len(pdf) else np.zeros((0, len(cells.id)))
            out = []
            for i, row in enumerate(low):
                order = np.lexsort((cells.id, row))
                start = int(np.searchsorted(np.cumsum(cells.n[order]), k)) + 1
                pick = order[:start] if first else [c for c in order[start:] if row[c] <= pdf["reach"].iloc[i] + _MARGIN]
                out += [(pdf["query_id"].iloc[i], pdf["q"].iloc[i], int(cells.id[c])) for c in pick]
            yield pd.DataFrame(out, columns=["query_id", "q", "cell"])
    return run


def _best(k: int):
    def run(q, v):
        out = {"query_id": [], "vec_id": [], "sim": []}
        if len(q) and len(v):
            sims, ids = _unit(q["q"]) @ _unit(v["v"]).T, v["vec_id"].to_numpy()
            for qid, row in zip(q["query_id"], sims):
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                at = np.flatnonzero(row >= least)
                at = at[np.lexsort((ids[at], -row[at]))][:k]
                out["query_id"] += [qid] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["sim"] += row[at].tolist()
        return pd.DataFrame(out)
    return run


def needed_cells(plan: DataFrame) -> list[int]:
    """The cells that some query reads; at most as many as the index has."""
    return sorted(r["cell"] for r in plan.select("cell").distinct().collect())


def cell_scan(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """The stored vectors of ``cells``: a partition filter, the others are not opened."""
    return spark.read.parquet(f"{path}/vectors").filter(F.col("cell").isin(cells))


def search_vector_index(spark: SparkSession, path: str, queries: DataFrame, k: int, q_id: str = "query_id", q_vec: str = "query",
                        report: dict | None = None) -> DataFrame:
    """Exact k nearest stored vectors by cosine per query: query_id, rank, vec_id, sim, as ``nearest`` gives them.

    Ties go by vector id.  ``report`` gets the number of cells, of those read, of the visits of queries to cells and of all
    that there could be.  A cell of any size is dealt to blocks
    by a hash of the ids, and so are the queries, so that a task's matrices are bounded."""
    from ..session import cut_lineage
    cells = _Cells(spark.read.parquet(f"{path}/cells").collect())
    qs = cut_lineage(queries.select(F.col(q_id).alias("query_id"), F.col(q_vec).cast("array<double>").alias("q")).filter("query_id is not null and q is not null"))
    qkind, vkind = dict(qs.dtypes)["query_id"], dict(spark.read.parquet(f"{path}/vectors").dtypes)["vec_id"]
    parts = max(1, -(-qs.count() // QUERY_BLOCK))
    # The table of cells as literals: blocks per cell.
    blocks = F.create_map(*[F.lit(x) for c, n in zip(cells.id, cells.n) for x in (int(c), int(-(-n // VECTOR_BLOCK)))]) if len(cells.id) else F.create_map(F.lit(0), F.lit(1))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("vec_id"))
    read, visits, asked = set(), [], qs.count() if report is not None else 0

    def hits(asked: DataFrame, first: bool) -> DataFrame:
        plan = cut_lineage(asked.mapInPandas(_plan(cells, k, first), f"query_id {qkind}, q array<double>, cell int"))
        need = needed_cells(plan)
        read.update(need)
        if report is not None:
            visits.append(plan.count())
        left = (plan.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("cell")) - 1))))
        right = (cell_scan(spark, path, need).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("cell"))).cast("int"))
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
        found = (left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part"))
                 .applyInPandas(_best(k), f"query_id {qkind}, vec_id {vkind}, sim double"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = cut_lineage(hits(qs.withColumn("reach", F.lit(0.0)), True))
    # The k-th best distance so far; without k vectors the first cells were all there are.
    reach = near.filter(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("sim"))).alias("reach"))
    rest = hits(qs.join(reach, "query_id"), False)
    if report is not None:
        report.update(cells=len(cells.id), read=len(read), visits=sum(visits), all_visits=len(cells.id) * asked)
    return (near.drop("rank").unionByName(rest.drop("rank")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "sim"))
