"""Inserts with a report (U1): what is read, inserted and skipped, and what the report writes on the way."""

import pytest
from pyspark.sql import functions as F

from repolens import session
from repolens.operators import load as U

KEYS = ["repo_owner", "repo_name", "commit_hash", "filename"]
KIND = "repo_owner string, repo_name string, commit_hash string, filename string, author string, pos int"


@pytest.mark.parametrize("by_range", (False, True))
def test_insert_counted_rows_and_report(spark, by_range):
    batch = spark.createDataFrame([("o", "r", "h1", "x", "b", 2), ("o", "r", "h1", "x", "a", 1), ("o", "r", "h2", "y", None, 3),
                                   ("o", "r", "h2", None, "n", 4), ("o", "q", "h2", "y", "c", 5), (None, "r", "h2", "y", "d", 6)], KIND)
    target = spark.createDataFrame([("o", "r", "h2", "y", "old", 0), ("o", "r", "h2", None, "old", 0), ("o", "r", "h9", "z", "old", 0)], KIND)
    new, report = U.insert_counted(target, batch, KEYS, ["pos"], by_range=by_range)
    assert new.schema == batch.schema
    assert sorted(r.pos for r in new.collect()) == [1, 4, 5, 6]      # a key with a null is in no target
    got = {(r.repo_owner, r.repo_name): (r.read, r.inserted, r.skipped) for r in report.collect()}
    assert got == {("o", "r"): (4, 2, 2), ("o", "q"): (1, 1, 0), (None, "r"): (1, 1, 0)}


def test_batch_and_target_meet_in_one_shuffle_and_skipped_rows_are_not_kept(spark, monkeypatch):
    cuts, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: cuts.append(df) or cut(df))
    rows = (spark.range(300).select(F.lit("o").alias("repo_owner"), F.lit("r").alias("repo_name"), F.col("id").cast("string").alias("commit_hash"),
                                    F.lit("x").alias("filename"), F.lit("a").alias("author"), F.col("id").cast("int").alias("pos")))
    assert U.insert_counted(rows.filter("pos >= 100"), rows, KEYS, ["pos"])[1].collect() == [("o", "r", 300, 100, 200)]
    kept, = cuts
    plan = kept._jdf.queryExecution().sparkPlan()
    planned = spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, plan).toString()
    assert planned.count("Exchange ") == 1 and "Join" not in planned
    assert kept.filter("commit_hash is not null or _r is not null").count() == 100
