"""Every registered query against its DuckDB oracle on the smallest data
(the driver's correctness gate runs the same comparison at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from repolens.plans import registry  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

ORACLES = {k: v for k, v in E.oracle_sql().items() if k in registry.QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_rows, s_cols = df.collect(), df.columns
    cur = con.execute(ORACLES[name])
    d_cols = [x[0] for x in cur.description]
    assert sorted(s_cols) == sorted(d_cols)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, cur.fetchall())


def test_every_query_runs_and_entry(spark):
    assert E.entry(spark).count() > 0
    for name in sorted(set(registry.QUERIES) - set(ORACLES)):
        assert E.queries()[name](spark, SF_SMALL).count() > 0, name
