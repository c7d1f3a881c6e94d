"""Runs steered by the log, rebuilt repositories, the describe chain."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from repolens.operators import annotate as L
from repolens.operators import runs as R
from repolens.operators import work as W
from repolens.schemas import CHANGES

ORDER = ["commit_hash"]


def changes(spark, rows):
    """(repo, hash, day of 2024, file, description)"""
    at = lambda d: dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=d - 1)
    return spark.createDataFrame([("o", r, h, None, at(d), "a", None, f, 1, t) for r, h, d, f, t in rows], CHANGES)


def hashes(df):
    return sorted((r.repo_name, r.commit_hash) for r in df.collect())


def test_second_run_reads_from_the_mark(spark, tmp):
    source, target, log = (os.path.join(tmp, x) for x in ("source", "target", "log"))
    first = [("r", "a", 1, "x", None), ("r", "b", 10, "x", None), ("s", "a", 3, "x", None)]
    more = [("r", "c", 10, "x", None), ("r", "late", 2, "x", None), ("r", "lost", 1, "y", None), ("s", "d", 30, "x", None), ("new", "e", 1, "x", None)]
    write = lambda rows: changes(spark, rows).write.mode("overwrite").partitionBy("repo_owner", "repo_name").parquet(source)
    read = lambda: spark.read.schema(CHANGES).parquet(source)
    write(first)
    assert R.run_incremental(read(), target, log, "2024-01-10T15:00:00", ORDER) == {"inserted": 3}
    write(first + more)
    batch = R.since_last_run(read(), R.last_runs(spark, log), late_days=8)
    # b is of the mark's day and read again; lost is older than the late days
    assert hashes(batch) == [("new", "e"), ("r", "b"), ("r", "c"), ("r", "late"), ("s", "a"), ("s", "d")]
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(committed_at,2024-01-02T00:00)" in plan and plan.count("FileScan parquet") == 2
    assert R.run_incremental(read(), target, log, "2024-01-31T00:00:00", ORDER, late_days=8) == {"inserted": 4}
    assert R.run_incremental(read(), target, log, "2024-02-01T00:00:00", ORDER, late_days=8) == {"inserted": 0}
    assert len(hashes(spark.read.parquet(target))) == 7
    marks = {r.repo_name: r.mark.isoformat() for r in R.last_runs(spark, log).collect()}
    assert marks == {"r": "2024-02-01T00:00:00", "s": "2024-02-01T00:00:00", "new": "2024-02-01T00:00:00"}


def test_marks_of_many_repositories_are_joined(spark, tmp, monkeypatch):
    ch = changes(spark, [("r", "a", 1, "x", None), ("r", "b", 9, "x", None), ("s", "a", 3, "x", None), ("t", "a", 3, "x", None)])
    marks = spark.createDataFrame([("o", "r", dt.datetime(2024, 1, 9, 18)), ("o", "s", dt.datetime(2024, 1, 9))], "repo_owner string, repo_name string, mark timestamp_ntz")
    named = hashes(R.since_last_run(ch, marks))
    monkeypatch.setattr(R, "MOST_NAMED", 1)
    assert hashes(R.since_last_run(ch, marks)) == named == [("r", "b"), ("t", "a")]
    assert R.last_runs(spark, os.path.join(tmp, "none")).count() == 0


def test_rebuild_replaces_whole_repositories_or_nothing(spark, tmp):
    path = os.path.join(tmp, "t")
    R.rebuild(changes(spark, [("r", "a", 1, "x", None), ("s:1", "a", 1, "x", None), ("gone", "a", 1, "x", None)]), path)
    R.rebuild(changes(spark, [("r", "b", 1, "x", None)]), path, repos=[("o", "r"), ("o", "gone")])
    read = lambda: hashes(spark.read.schema(CHANGES).parquet(path))
    assert read() == [("r", "b"), ("s:1", "a")]
    bad = changes(spark, [("r", "c", 1, "x", None), ("s:1", "c", 1, "x", None)]).withColumn(
        "churn_count", F.when(F.col("repo_name") == "r", F.lit(1).cast("bigint")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        R.rebuild(bad, path)
    assert read() == [("r", "b"), ("s:1", "a")]
    R.rebuild(changes(spark, []), path, repos=[("o", "s:1")])
    assert read() == [("r", "b")]


def test_describe_chain(spark, tmp):
    rows = [("r", h, 1, f, t) for h, f, t in [("a", "diff.py", None), ("b", "content.py", None), ("c", "none.py", None), ("d", "bad.py", None), ("e", "long.py", None),
                                              ("f", "endless.py", None), ("g", "done.py", "is there"), ("h", "README.md", None), ("i", "late.py", None), ("j", "unknown.py", None)]]
    ch = changes(spark, rows)
    data = {"diff.py": ("+x", "never read"), "content.py": (None, "y"), "none.py": (None, None), "bad.py": ("garbage", None), "long.py": ("l" * 30, None),
            "endless.py": ("endless" * 9, None), "late.py": ("flaky", None), "done.py": ("+z", None), "README.md": ("+z", None)}
    src = spark.createDataFrame([("o", "r", h, f, *data[f]) for _, h, _, f, _ in rows if f in data], "repo_owner string, repo_name string, commit_hash string, filename string, diff string, content string")
    seen = os.path.join(tmp, "seen")

    def model(prompts):
        out = []
        for p in prompts:
            text = p.split("\n", 2)[2]
            if "flaky" in text and not os.path.exists(seen):
                open(seen, "w").close()
                raise OSError("no answer")
            out.append("@@@" if "garbage" in text else text if "endless" in text else text[:10] if "Shorten" in p else text)
        return out
    work = W.run_work(W.describe_work(ch, src), model, os.path.join(tmp, "store"), max_len=20, max_attempts=2, rounds=3)
    got = {r.filename: (r.state, r.source, r.attempts, r.tries, r.reason) for r in work.collect()}
    assert got == {
        "diff.py": ("described", "diff", 0, 0, None), "content.py": ("described", "content", 0, 0, None), "none.py": ("rejected", None, 0, 0, "no diff and no content"),
        "bad.py": ("rejected", "diff", 2, 0, "no usable answer"), "long.py": ("described", "diff", 0, 1, None),
        "endless.py": ("rejected", "diff", 0, 3, "never short enough"), "late.py": ("described", "diff", 0, 0, None), "unknown.py": ("rejected", None, 0, 0, "no diff and no content")}
    after = {r.filename: r.description for r in W.write_back(ch, work).collect()}
    assert after == {"diff.py": "+x", "content.py": "y", "none.py": None, "bad.py": None, "long.py": "l" * 10, "endless.py": None, "done.py": "is there",
                     "README.md": None, "late.py": "flaky", "unknown.py": None}
    assert {r.prompt.split("\n")[0] for r in L.rejects(spark, os.path.join(tmp, "store")).collect()} == {"Filename: bad.py"}
    assert W.run_work(W.describe_work(ch.filter("false"), src), model, os.path.join(tmp, "store")).count() == 0


def test_rows_of_equal_content_are_one_task(spark, tmp, monkeypatch):
    # 30 commits of 3 contents; the model is asked about 3, and again about one
    rows = spark.range(30).selectExpr("'o' as repo_owner", "if(id < 15, 'r', null) as repo_name", "concat('c', id) as commit_hash",
                                      "concat('f', id % 3, '.py') as filename", "cast(null as string) as description")
    src = rows.select(*W.KEYS, F.when(F.col("filename") != "f2.py", "d").alias("diff"), F.lit(None).cast("string").alias("content")).filter("repo_name is not null")
    asked, plain = [], W.annotate

    def spy(df, *args, **more):
        asked.append(df.count())
        return plain(df, *args, **more)
    monkeypatch.setattr(W, "annotate", spy)
    work = W.run_work(W.describe_work(rows, src), lambda prompts: ["word " * (9 if "f0" in p and "Shorten" not in p else 1) for p in prompts], os.path.join(tmp, "store"), max_len=20)
    assert asked == [2, 1] and work.columns == [*W.KEYS, "source", "data", "text", "state", "attempts", "tries", "reason"]
    got = {(r.filename, r.repo_name, r.state, r.text, r.attempts, r.tries): r["n"] for r in
           work.groupBy("filename", "repo_name", "state", "text", "attempts", "tries").agg(F.count("*").alias("n")).collect()}
    assert got == {("f0.py", "r", "described", "word", 0, 1): 5, ("f1.py", "r", "described", "word", 0, 0): 5,
                   ("f2.py", "r", "rejected", None, 0, 0): 5, **{(f"f{i}.py", None, "rejected", None, 0, 0): 5 for i in range(3)}}


def test_changes_are_computed_once(spark, tmp, monkeypatch):
    from repolens.plans import queries_load, queries_runs
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x
    ch = spark.range(12).selectExpr(
        "'o' as repo_owner", "'r' as repo_name", "concat('c', id) as commit_hash", "cast('2024-01-01' as timestamp_ntz) as committed_at",
        "concat('f', id % 4, '.py') as filename", "id as churn_count", "if(id % 4 = 3, 'held', null) as description")
    ch = ch.withColumn("filename", F.udf(seen, "string")("filename"))
    for queries, query in ((queries_load, "q_backfill_from_log"), (queries_runs, "q_describe_changes")):
        made.value = 0
        monkeypatch.setattr(queries.X, "changes_long", lambda *_: ch)
        found = getattr(queries, query)(spark, tmp).collect()
        assert 9 <= made.value <= 12, query
        if query == "q_backfill_from_log":
            assert sorted(r.description for r in found if r.enabled) == sorted(["held"] * 3 + [f"new f{i}.py\nsecond line" for i in range(3)] * 3)


def test_described_changes_are_not_shuffled_to_the_log(spark):
    from repolens.operators.load import backfill_descriptions
    ch = spark.createDataFrame([("o", None, "a", "f", "held"), ("o", "r", "a", "f", None), ("o", "r", "b", "f", None), ("o", None, "b", "f", None)],
                               "repo_owner string, repo_name string, commit_hash string, filename string, description string")
    log = spark.sql("select 'o' as repo_owner, 'r' as repo_name, 'f' as filename, 'a' as commit_hash, timestamp_ntz '2024-01-01 00:00:00' as logged_at, 1L as position, 'new' as text")
    out = backfill_descriptions(ch, log)
    assert sorted(map(str, out.collect())) == sorted(map(str, ch.na.fill({"description": "-"}).replace("-", None, ["description"])
                                                         .withColumn("description", F.when((F.col("repo_name") == "r") & (F.col("commit_hash") == "a"), "new").otherwise(F.col("description"))).collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter isnull(description" in plan and "Union" in plan
