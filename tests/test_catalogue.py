"""Catalogue queries (R8), schema description (R9), source-file reading
(S8) with the ignore filter (S9)."""

import datetime as dt
import os

from repolens.operators import catalogue as K
from repolens.sources.source_files import filter_ignored, read_source_files


def test_describe_schema(spark):
    d = K.describe_schema(spark)
    tables = {r.table for r in d.collect()}
    assert tables == {"changes", "tags", "commit_tags", "pull_requests", "summaries"}
    cols = {(r.table, r.column) for r in d.collect()}
    assert ("changes", "churn_count") in cols and ("commit_tags", "value") in cols


def test_every_column_has_a_meaning(spark):
    from pyspark.sql import types as T
    from repolens import schemas

    def fields(t):
        for f in t.fields:
            yield f
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                yield from fields(inner)
    for name, (schema, meaning) in (schemas.TABLES | schemas.FILES).items():
        assert meaning and all(f.metadata["meaning"] for f in fields(schema)), name
    assert all(r.meaning for r in K.describe_schema(spark).collect())
    rows = spark.createDataFrame([("o", "r", 1, "x"), ("o", "r", 2, "y")], schemas.TAGS)
    got = {r.column: (r.rows, r.filled) for r in K.profile("tags", rows.withColumn("name", rows["name"])).collect()}
    assert got == {c: (2, 2) for c in ("repo_owner", "repo_name", "tag_id", "name")}


def test_catalogue_dispatch(spark):
    s = spark.createDataFrame(
        [("o", "r", "a", "m1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)),
         ("o", "r", "b", "m2", dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 31))],
        "repo_owner string, repo_name string, name string, ai_model string, "
        "start_date timestamp_ntz, end_date timestamp_ntz")
    assert {r.name for r in K.catalogue("summary_names", s).collect()} == {"a", "b"}
    assert [r.name for r in K.catalogue("summaries_by_model", s, model="m2").collect()] == ["b"]
    got = K.catalogue("summaries_in_range", s, start="2024-01-01", end="2024-02-15").collect()
    assert [r.name for r in got] == ["a"]


def test_read_source_files_and_ignore(spark, tmp):
    for rel, text in [("src/a.py", "def f():\n    return 1\n"), ("src/b.txt", "x"),
                      ("build/gen.py", "x = 1\n"), ("web/app.js", "function g() {}\n")]:
        p = os.path.join(tmp, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        open(p, "w").write(text)
    files = read_source_files(spark, tmp, repo_owner="o", repo_name="r")
    rel = files.withColumn("rel_path", files.file_path.substr(len(tmp) + 2, 10_000))
    kept = filter_ignored(rel, ["build/"])
    assert sorted(r.rel_path for r in kept.collect()) == ["src/a.py", "web/app.js"]
    allf = read_source_files(spark, tmp, exts=None, repo_owner="o", repo_name="r")
    assert allf.count() == 4
