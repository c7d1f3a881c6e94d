"""Chunking, nearest neighbours against brute force, tree summary, routing
(R1-R7)."""

import numpy as np
from pyspark.sql import functions as F

from repolens.operators import annotate as L
from repolens.operators import retrieve as R
from tests.conftest import SF_SMALL


def test_split_chunks_cover_text():
    text = " ".join(f"Sentence number {i} has some words." for i in range(300))
    chunks = R.split_chunks(text, size=100, overlap=0)
    assert all(len(c) <= 400 for c in chunks)
    assert " ".join(chunks) == text
    over = R.split_chunks(text, size=100, overlap=30)
    assert len(over) > len(chunks)
    long_word_run = "word " * 1000
    assert all(len(c) <= 400 for c in R.split_chunks(long_word_run, size=100, overlap=0))


def test_nearest_matches_brute_force(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = emb.filter(F.col("vec_id") % 7 == 0).select(F.col("vec_id").alias("query_id"),
                                                     F.col("embedding").alias("query"))
    got = {(r.query_id, r.rank): r.vec_id for r in R.nearest(q, emb, 4).collect()}
    rows = emb.collect()
    ids = np.array([r.vec_id for r in rows])
    m = np.array([r.embedding for r in rows], dtype=np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    for r in q.collect():
        v = np.array(r.query, dtype=np.float64)
        s = m @ (v / np.linalg.norm(v))
        order = np.lexsort((ids, -s))[:4]
        for k, j in enumerate(order):
            assert got[(r.query_id, k + 1)] == ids[j]


def test_nearest_blocks_of_queries(spark, monkeypatch):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = {(r.query_id, r.rank): r.vec_id for r in R.nearest(q, emb, 2).collect()}
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    blocks = {(r.query_id, r.rank): r.vec_id for r in R.nearest(q, emb, 2).collect()}
    assert whole == blocks
    assert all(whole[(i, 1)] == i for i in range(5))   # each vector is its own nearest


def test_tree_summary_one_per_group(spark, tmp):
    df = spark.createDataFrame([("g1", i, f"piece {i}.") for i in range(20)] + [("g2", 0, "only.")],
                               "g string, pos int, t string")
    out = {r.g: r for r in R.tree_summarise(df, ["g"], "pos", "t", L.ExtractiveCompleter(50),
                                            tmp + "/cache", fan_in=3).collect()}
    assert set(out) == {"g1", "g2"} and out["g1"].levels == 3


def test_route(spark, tmp):
    qs = spark.createDataFrame([(1, "summarization of the codebase please"),
                                (2, "show me the source code itself")], "id int, q string")
    got = {r.id: r.index_name for r in R.route(qs, "q", L.Router(R.TOOLS), tmp + "/c").collect()}
    assert got == {1: "summary", 2: "code_vector"}


def test_routed_search_opens_its_own_indexes_only(spark, tmp):
    import os
    import numpy as np
    from repolens.operators import retrieve as R
    from repolens.sources import source_files as SF
    rng = np.random.default_rng(1)
    names = ["summary", "vector", "code_vector"]
    rows = [(i, names[i % 3], rng.normal(size=5).tolist()) for i in range(90)]
    path = os.path.join(tmp, "indexes")
    SF.write_index(spark.createDataFrame(rows, "vec_id long, index_name string, embedding array<double>"), path)
    asked = [(100 + i, names[i % 2], rng.normal(size=5).tolist()) for i in range(8)] + [(200, "no such index", [1.0] * 5)]
    got = R.search_routed(spark.createDataFrame(asked, "query_id long, index_name string, query array<double>"), SF.read_index(spark, path), 4)
    found = got.collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q, name, v in asked[:8]:
        want = sorted(((-float(unit(v) @ unit(x)), i) for i, n, x in rows if n == name))[:4]
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in want]
    assert {r.query_id for r in found} == set(range(100, 108))
    # the scan learns the routed indexes from the other side of the join while the query runs
    ran = got._jdf.queryExecution()
    assert "dynamicpruning#" in ran.optimizedPlan().toString()
    scans = [x for x in ran.executedPlan().toString().splitlines() if "dynamicpruning#" in x]
    assert any("SubqueryBroadcast" in x or "ReusedSubquery" in x or "SubqueryAdaptiveBroadcast" in x for x in scans)
