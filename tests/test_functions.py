"""Scalar column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from repolens.functions import text as P
from repolens.functions import time as T


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col.alias("y")).collect()[0].y


def test_strip_offset_and_parse_churn(spark):
    assert one(spark, P.strip_offset("x"), "2024-07-30T12:00:00-07:00") == "2024-07-30T12:00:00"
    assert one(spark, P.strip_offset("x"), "2024-07-30T12:00:00") == "2024-07-30T12:00:00"
    assert one(spark, P.parse_churn("x"), "-") == 0
    assert one(spark, P.parse_churn("x"), " ") == 0
    assert one(spark, P.parse_churn("x"), "12") == 12
    with pytest.raises(Exception):
        one(spark, P.parse_churn("x"), "1x")  # a bad number fails the job, as in the source


def test_exclude_empty_pattern_excludes_nothing(spark):
    assert one(spark, P.exclude("x", ""), "anything") is True
    assert one(spark, P.exclude("x", "dependabot|github"), "GitHub Actions") is False


@pytest.mark.parametrize("path,code", [
    ("src/app.py", True), ("README.md", False), ("a/b/logo.PNG", True), ("x.lock", False),
    (".eslintrc", False), ("src/.env.local", True), (".github/ci.yml", False),
    (".github/run.sh", False), ("Makefile", True), ("docs/x.yaml", False),
])
def test_is_code_file(spark, path, code):
    assert one(spark, P.is_code_file("x"), path) is code


def test_text_helpers(spark):
    assert one(spark, P.highlight("x", "<b>", "</b>"), "a ||b|| c ||d||") == "a <b>b</b> c <b>d</b>"
    assert one(spark, P.highlights("x"), "a ||b|| c ||d||") == ["b", "d"]
    assert one(spark, P.format_description("x"), "1. one\n2. two") == \
        "&nbsp;&#8226;&nbsp;one<BR>&nbsp;&#8226;&nbsp;two"
    assert one(spark, P.fmt2("x"), 2.675, "double") == "2.68"      # HALF_UP on the decimal (D16)
    assert one(spark, P.fmt2("x"), 0.125, "double") == "0.13"
    assert one(spark, P.rel_path("x"), "/tmp/o-r/_source/src/a.py") == "src/a.py"
    assert one(spark, P.resolve_rename("x"), "src/{old => new}/a.py") == "src/old/a.py"
    assert one(spark, P.clean_message("x"), "a--b\nc") == "a b c"
    assert one(spark, P.split_model("x")[1], "openai|gpt-4o-mini") == "gpt-4o-mini"
    assert one(spark, P.diff_key(F.lit("abc"), F.lit("f.py")), "") == \
        __import__("hashlib").sha256(b"abc-f.py").hexdigest()
    assert one(spark, P.score_key("x"), "def f(): pass") == \
        __import__("hashlib").md5(b"score\tdef f(): pass").hexdigest()


def test_iso_weeks(spark):
    assert one(spark, T.iso_week("x"), dt.date(2024, 12, 30), "date") == "2025-01"
    assert one(spark, T.iso_week("x"), dt.date(2021, 1, 1), "date") == "2020-53"
    assert one(spark, T.iso_week("x"), None, "date") is None
    assert one(spark, T.week_start("x"), dt.date(2021, 1, 1), "date") == dt.date(2020, 12, 28)
    assert one(spark, T.days_ago("x", "2024-02-01"), dt.date(2024, 1, 1), "date") == 31
    assert one(spark, T.display_mdy("x"), dt.date(2024, 1, 5), "date") == "01/05/2024"


def test_since_is_pushed_to_the_scan(spark, tmp):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in range(1, 10)],
                               "committed_at timestamp_ntz")
    df.write.parquet(tmp + "/t")
    q = T.since(spark.read.parquet(tmp + "/t"), "01/05/2024")
    assert q.count() == 5
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(committed_at), GreaterThanOrEqual(committed_at" in plan
