"""The content-addressed store (L9, R4): nothing is asked twice, and the store is joined by bucket."""

import os
import random

from pyspark.sql import functions as F

from repolens.operators import annotate as L
from repolens.operators import retrieve as R
from repolens.operators import store as S
from repolens.session import checkpoint_dir


def kept(spark):
    """Folders of this session's tables of kept rows."""
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {os.path.join(folder, t.name) for t in spark.catalog.listTables() if t.name.startswith("rows_")}


def texts(spark, ids):
    return spark.createDataFrame([(i, f"text {i % 7}") for i in ids], "id int, text string")


def test_second_run_makes_no_calls(spark, tmp):
    path = os.path.join(tmp, "store")
    calls = lambda: L.cache_size(spark, path)
    first = L.annotate(texts(spark, range(5)), F.col("text"), L.ExtractiveCompleter(5), path)
    assert calls() == 5
    # Both results in one plan: the older one still holds what it held.
    second = L.annotate(texts(spark, range(3, 30)), F.col("text"), L.ExtractiveCompleter(5), path)
    assert calls() == 7
    both = first.unionByName(second).collect()
    assert len(both) == 32 and all(r.answer == r.text for r in both)
    def fail(prompts):
        raise AssertionError("asked again")
    again = L.annotate(texts(spark, range(30)), F.col("text"), fail, path)
    assert again.filter("answer is null").count() == 0 and calls() == 7 and L.rejects(spark, path).count() == 0


def test_vectors_are_stored_by_text_and_model(spark, tmp):
    path = os.path.join(tmp, "store")
    plain = {r.id: r.embedding for r in R.embed(texts(spark, range(20)), "text", R.HashingEmbedder(8)).collect()}
    got = R.embed(texts(spark, range(10)).unionByName(spark.createDataFrame([(99, None)], "id int, text string")), "text", R.HashingEmbedder(8), store_path=path)
    assert {r.id: r.embedding for r in got.collect()} == {**{i: plain[i] for i in range(10)}, 99: [0.0] * 8}
    assert S.read_store(spark, path).filter("vector is not null").count() == 8
    again = R.embed(texts(spark, range(20)), "text", lambda t: [[None]] * len(t), store_path=path)
    assert {r.id: r.embedding for r in again.collect()} == plain
    R.embed(texts(spark, range(3)), "text", R.HashingEmbedder(4), store_path=path, model="other")
    assert S.read_store(spark, path).groupBy("model").count().count() == 2


def test_store_is_joined_by_bucket_without_a_shuffle(spark, tmp):
    path = os.path.join(tmp, "store")
    L.annotate(texts(spark, range(7)), F.col("text"), L.ExtractiveCompleter(5), path).count()
    wanted = texts(spark, range(9)).select(S.content_key("offline", F.col("text")).alias("key")).distinct()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        join = S.missing(wanted, path, F.col("answer").isNotNull())
        plan = join._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x)
    assert "Bucketed: true" in lines[scan] and "SortMergeJoin" in plan
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    above, at = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
            if "Join" in x:
                break
    assert not any("Exchange" in x for x in above), plan
    assert join.count() == 0


def test_a_store_keeps_its_buckets(spark, tmp):
    path = os.path.join(tmp, "store")
    name = S.open_store(spark, path, buckets=3)
    S.append(spark.createDataFrame([(f"k{i}", f"a{i}") for i in range(50)], "key string, answer string"), path)
    assert S.open_store(spark, path, buckets=9) == name
    spark.sql(f"drop table {name}")                         # as a new session sees it
    assert S.read_store(spark, path).count() == 50
    assert sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs) == 3


def test_odd_rows_are_answered_each_on_its_own(spark, tmp):
    # equal texts in many rows, no text, a prompt that is a column here and is none there, columns of odd names and no type
    rows = spark.createDataFrame([(1, "a b", "k1", "x"), (1, "a b", "k1", "x"), (2, "", None, "y"), (3, "c", "k3", "c"), (4, "a b", "k4", None)],
                                 "id int, text string, key string, other string").withColumn("none", F.lit(None))
    prompt = F.when(F.col("id") == 4, F.lit("a b c")).when(F.col("id") == 3, F.col("other")).otherwise(F.col("text"))
    for callers in (None, 2):
        path = os.path.join(tmp, f"store{callers}")
        got = L.annotate(rows, prompt, lambda ps: [f"<{p}>" for p in ps], path, max_callers=callers)
        assert got.columns == [*rows.columns, "answer"] and got.schema["none"].dataType.typeName() == "void"
        assert sorted((r.id, r.key, r.answer) for r in got.fillna("-", "key").collect()) == [
            (1, "k1", "<a b>"), (1, "k1", "<a b>"), (2, "-", "<>"), (3, "k3", "<c>"), (4, "k4", "<a b c>")]
        assert sorted(r.prompt for r in S.read_store(spark, path).collect()) == ["", "a b", "a b c", "c"]
        full = R.embed(got, "text", R.HashingEmbedder(4), store_path=path)
        assert full.columns == [*got.columns, "embedding"] and full.filter("embedding is null").count() == 0
        assert S.read_store(spark, path).filter("vector is not null").count() == 3


def test_texts_stay_where_they_are_written(spark, tmp):
    path, rng = os.path.join(tmp, "store"), random.Random(1)
    long = spark.createDataFrame([(i, "%x" % rng.getrandbits(20_000)) for i in range(200)], "id int, text string")
    before = kept(spark)
    got = L.annotate(long, F.col("text"), lambda ps: [p[:9] for p in ps], path)
    # 1 MB of texts, half of it once packed: written once, not again as prompts
    rows, = kept(spark) - before
    assert 400_000 < sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(rows) for f in fs) < 800_000
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "text:string" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    above, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            above.append(x)
            d = depth(x)
    assert "Bucketed: true" in lines[at] and not any("Exchange" in x for x in above), lines
    assert got.filter("answer = substring(text, 1, 9)").count() == 200


def test_kept_rows_of_a_finished_run_are_deleted(spark, tmp):
    path, before = os.path.join(tmp, "store"), kept(spark)
    outer = L.annotate(texts(spark, range(3)), F.col("text"), L.ExtractiveCompleter(5), path)
    own, = kept(spark) - before
    with S.drop_kept_rows(spark):
        inner = L.annotate(texts(spark, range(9)), F.col("text"), L.ExtractiveCompleter(5), path)
        assert inner.filter("answer = text").count() == 9
        made, = kept(spark) - before - {own}
        assert os.path.isdir(made)
    assert kept(spark) - before == {own} and not os.path.exists(made)
    assert outer.filter("answer = text").count() == 3
    assert S.read_store(spark, path).filter("answer is not null").count() == 7
