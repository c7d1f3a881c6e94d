"""The stored neighbour index (R5): equal to brute force, whatever the cells, and it leaves cells unread."""

import os

import numpy as np
import pytest

from repolens.operators import retrieve as R
from repolens.operators import vector_index as V


def clustered(seed, groups, size, dims):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims)) * 5
    return [(g * size + i, (centre[g] + rng.normal(size=dims) * 0.3).tolist()) for g in range(groups) for i in range(size)]


def plain(rows, queries, k):
    u = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or np.inf)
    out = []
    for q, x in queries:
        hits = sorted((-round(float(u(x) @ u(v)), 9), i) for i, v in rows if i is not None and v is not None)
        out += [(q, r + 1, i) for r, (_, i) in enumerate(hits[:k])]
    return out


@pytest.mark.parametrize("cells, sample, block, queries_block", [(12, 20_000, 16_384, 4096), (1, 50, 16_384, 4096), (40, 60, 7, 3)])
def test_index_equals_brute_force(spark, tmp, monkeypatch, cells, sample, block, queries_block):
    monkeypatch.setattr(V, "VECTOR_BLOCK", block)
    monkeypatch.setattr(V, "QUERY_BLOCK", queries_block)
    rows = clustered(3, 12, 30, 6) + [(1000, [0.0] * 6), (1001, [0.0] * 6), (1002, None), (None, [1.0] * 6)]
    rows += [(2000 + i, rows[5][1]) for i in range(8)]  # ties
    queries = [(i, v) for i, v in rows[:360:23]] + [(-1, [0.0] * 6), (-2, rows[5][1])]
    path = os.path.join(tmp, "index")
    V.write_vector_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), path, cells, sample=sample)
    report = {}
    got = V.search_vector_index(spark, path, spark.createDataFrame(queries, "query_id long, query array<double>"), 5, report=report).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(plain(rows, queries, 5))
    assert report["read"] <= report["cells"] <= cells + 1
    if cells == 12:
        # The zero query needs every cell; the others need few.
        assert report["visits"] < report["all_visits"] / 3


def test_a_query_leaves_cells_unread(spark, tmp):
    rows = clustered(4, 20, 50, 8)
    path = os.path.join(tmp, "index")
    V.write_vector_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), path, 20)
    report, query = {}, spark.createDataFrame([("q", rows[77][1])], "query_id string, query array<double>")
    got = V.search_vector_index(spark, path, query, 3, report=report)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [i for _, _, i in plain(rows, [("q", rows[77][1])], 3)]
    assert report["read"] <= 3 and report["cells"] == 20
    scan = V.cell_scan(spark, path, [1, 2])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and {r.cell for r in scan.collect()} == {1, 2}


def test_few_or_no_vectors(spark, tmp):
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, query array<double>")
    V.write_vector_index(some, os.path.join(tmp, "a"))
    assert [r.vec_id for r in V.search_vector_index(spark, os.path.join(tmp, "a"), queries, 5).orderBy("rank").collect()] == [1, 2]
    V.write_vector_index(some.filter("vec_id = 2"), os.path.join(tmp, "b"))
    assert V.search_vector_index(spark, os.path.join(tmp, "b"), queries, 5).count() == 1
    assert R.nearest(queries, some, 5).count() == 2
