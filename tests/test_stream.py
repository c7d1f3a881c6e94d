"""Streaming intake (U9): a re-run adds nothing; a new file adds only its
records."""

import os

import pytest

from repolens.streaming import ingest
from repolens.streaming.ingest import ingest_stream

A = ("^^a1--1.0--2024-07-29T12:00:00+00:00--Ann--a@x--m\n1\t1\tx.py\n2\t0\ty.py\n\n"
     "^^a2--2.0--2024-07-30T12:00:00+00:00--Bob--b@x--m\n1\t1\tx.py\n")
B = ("^^a2--2.0--2024-07-30T12:00:00+00:00--Bob--b@x--m\n9\t9\tx.py\n\n"
     "^^a3--3.0--2024-07-31T12:00:00+00:00--Cy--c@x--m\n1\t0\tz.py\nbad line\n")


def test_ingest_idempotent_and_incremental(spark, tmp):
    src, tgt, ck = (os.path.join(tmp, n) for n in ("in", "tgt", "ck"))
    os.makedirs(src)
    open(os.path.join(src, "a.txt"), "w").write(A)
    s1 = ingest_stream(spark, src, tgt, ck, "o", "r")
    assert s1["inserted"] == 3
    s2 = ingest_stream(spark, src, tgt, ck, "o", "r")
    assert s2["inserted"] == 0 and spark.read.parquet(tgt).count() == 3
    open(os.path.join(src, "b.txt"), "w").write(B)
    s3 = ingest_stream(spark, src, tgt, ck, "o", "r")
    assert s3["inserted"] == 1 and s3["rejected"] == 1
    rows = {(r.commit_hash, r.filename): r.churn_count for r in spark.read.parquet(tgt).collect()}
    assert rows == {("a1", "x.py"): 2, ("a1", "y.py"): 2, ("a2", "x.py"): 2, ("a3", "z.py"): 1}
    # a fresh checkpoint re-reads every file; the anti join still adds nothing
    s4 = ingest_stream(spark, src, tgt, os.path.join(tmp, "ck2"), "o", "r")
    assert s4["inserted"] == 0


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_killed_and_replayed_epoch_leaves_the_same(spark, tmp, monkeypatch):
    src, tgt, ck = (os.path.join(tmp, n) for n in ("in", "tgt", "ck"))
    os.makedirs(src)
    open(os.path.join(src, "a.txt"), "w").write(A)
    ingest_stream(spark, src, tgt, ck, "o", "r")
    open(os.path.join(src, "b.txt"), "w").write(B + "^^no header\n")
    ends = []

    def end(epoch):
        ends.append(epoch)
        if len(ends) < 3:
            raise RuntimeError("killed")
    monkeypatch.setattr(ingest, "_after_write", end)
    seen = []
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            ingest_stream(spark, src, tgt, ck, "o", "r")
        seen.append((rows(spark.read.parquet(tgt)), rows(spark.read.parquet(tgt + "-rejects"))))
    stats = ingest_stream(spark, src, tgt, ck, "o", "r")
    assert stats == {"inserted": 1, "skipped": 1, "rejected": 2, "batches": 1}
    assert len(set(ends)) == 1
    assert seen[0] == seen[1] == (rows(spark.read.parquet(tgt)), rows(spark.read.parquet(tgt + "-rejects")))
    assert {(r.kind, r.text) for r in spark.read.parquet(tgt + "-rejects").collect()} == {("line", "bad line"), ("record", "no header")}
    assert spark.read.parquet(tgt).count() == 4


def test_target_is_pruned_and_the_batch_parsed_once(spark, tmp, monkeypatch):
    src, tgt, ck = (os.path.join(tmp, n) for n in ("in", "tgt", "ck"))
    for repo, text in (("007", A), ("x", A)):
        os.makedirs(os.path.join(src, "repo_owner=o", f"repo_name={repo}"))
        open(os.path.join(src, "repo_owner=o", f"repo_name={repo}", "a.txt"), "w").write(text)
    ingest_stream(spark, src, tgt, ck)
    open(os.path.join(src, "repo_owner=o", "repo_name=007", "b.txt"), "w").write(B)
    plans = []
    plain = ingest.insert_new

    def spy(*args):
        plans.append(plain(*args))
        return plans[-1]
    monkeypatch.setattr(ingest, "insert_new", spy)
    ingest_stream(spark, src, tgt, ck)
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "repo_name#" in plan.split("PartitionFilters:")[1].split("]")[0] and "FileScan text" not in plan
    assert rows(ingest.read_target(spark, tgt).groupBy("repo_name").count()) == [("007", 4), ("x", 3)]


def test_a_broken_target_is_not_taken_for_an_empty_one(spark, tmp):
    src, tgt = os.path.join(tmp, "in"), os.path.join(tmp, "tgt")
    os.makedirs(src)
    os.makedirs(os.path.join(tgt, "epoch_id=x", "repo_owner=o", "repo_name=r"))
    open(os.path.join(src, "a.txt"), "w").write(A)
    open(os.path.join(tgt, "epoch_id=x", "repo_owner=o", "repo_name=r", "part-0.parquet"), "w").write("no parquet")
    with pytest.raises(Exception):
        ingest_stream(spark, src, tgt, os.path.join(tmp, "ck"), "o", "r")


def test_large_and_heavy_batches_insert_what_small_ones_do(spark, tmp, monkeypatch):
    # by commit in one shuffle; groups of commits of many rows apart; a key
    # without a repository equals none
    def folder(n, repo, text):
        os.makedirs(os.path.join(tmp, "in", "repo_owner=o", f"repo_name={repo}"), exist_ok=True)
        open(os.path.join(tmp, "in", "repo_owner=o", f"repo_name={repo}", f"{n}.txt"), "w").write(text)
    seen = {}
    for step in (1, 2):
        for repo in ("r", "__HIVE_DEFAULT_PARTITION__"):
            folder(step, repo, A if step == 1 else A + "\n" + B)
        for way, small, most in (("small", 100, 100), ("near", 0, 10 ** 6), ("heavy", 0, 2)):
            monkeypatch.setattr(ingest, "SMALL_BATCH", small)
            monkeypatch.setattr(ingest, "MOST_IN_GROUP", most)
            tgt = os.path.join(tmp, f"tgt-{way}")
            stats = ingest_stream(spark, os.path.join(tmp, "in"), tgt, os.path.join(tmp, f"ck-{way}"))
            found = ingest.read_target(spark, tgt).drop("epoch_id").collect()
            seen[way, step] = (stats, sorted(map(str, found)))
    for step in (1, 2):
        assert len({str(seen[w, step]) for w in ("small", "near", "heavy")}) == 1
    assert seen["near", 2][0] == {"inserted": 5, "skipped": 5, "rejected": 2, "batches": 1}


def test_large_batch_meets_the_target_in_one_shuffle(spark):
    from repolens.operators.load import insert_new, insert_new_near
    batch = spark.range(50).selectExpr("'o' as repo_owner", "'r' as repo_name", "concat('c', id div 8) as commit_hash",
                                       "concat('f', id % 3) as filename", "id as churn_count", "-id as at")
    keys = ingest.KEYS
    target = batch.filter("churn_count < 9").select(*keys)
    near = insert_new_near(target, batch, keys, ["at"], keys[:3])
    plan = near._jdf.queryExecution().executedPlan().toString()      # before the run: afterwards it holds the final plan, too
    assert plan.count("Exchange hashpartitioning") == 1
    assert rows(near) == rows(insert_new(target, batch, keys, ["at"])) and near.count() > 0


def test_first_of_a_key_is_not_shuffled_again_for_a_join(spark):
    from repolens.operators.load import first_per_key
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(20).selectExpr("id % 5 as k", "id as v")
        first = first_per_key(left, ["k"], ["v"])
        joined = first.join(spark.range(9).selectExpr("id as k"), "k", "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning") == 2 and first.columns == left.columns
    assert rows(first) == [(k, k) for k in range(5)]


def test_parse_splits_a_record_once(spark, tmp):
    from repolens.sources.commit_log import parse_commit_lines, read_log_records
    odd = "^^ \n\x0b" + A[2:] + "\f^^a4--4.0--2024-07-30T12:00:00+00:00--Di--d@x--m\n1\t1\tw.py  "
    open(os.path.join(tmp, "a.txt"), "w", newline="").write(odd)
    lines = parse_commit_lines(read_log_records(spark, tmp, "o", "r"))
    found = {(r.commit_hash, r.filename, r.kind) for r in lines.collect()}
    # the whitespace before a last line end of another kind goes, too
    assert found == {("a1", "x.py", None), ("a1", "y.py", None), ("a2", "x.py", None), ("a4", "w.py ", None)}
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert all("split(" not in part.split("\n")[0] for part in plan.split("Filter")[1:])
