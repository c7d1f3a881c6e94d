"""Plan properties the operators rely on at scale: no pair-producing
joins anywhere, partial top-n before the shuffle, filters pushed into the
scan, columns pruned."""

import pytest

import __spark_entry__ as E
from repolens.plans import registry
from tests.conftest import SF_SMALL

QUERIES = {k: v for k, v in E.queries().items() if k in registry.QUERIES}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_top_n_limits_before_shuffle(spark):
    df = QUERIES["author_commits"](spark, SF_SMALL)
    df.collect()
    p = plan(df)
    assert "WindowGroupLimit" in p


def test_since_pushed_and_columns_pruned(spark):
    df = QUERIES["author_commits_since"](spark, SF_SMALL)
    p = plan(df)
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in p
