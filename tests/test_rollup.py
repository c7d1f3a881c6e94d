"""Batch-wise summaries equal those of all rows at once, in any order and over repeated runs."""

import datetime as dt
import itertools
import os
import random

import pytest

from repolens.operators import activity as A
from repolens.operators import rollup as R
from repolens.operators import tags as G
from repolens.schemas import CHANGES


def changes(spark, seed, n=120):
    r = random.Random(seed)
    keys = {(f"r{r.randrange(2)}", f"h{r.randrange(25)}", f"f{r.randrange(9)}") for _ in range(n)}
    at = lambda h: dt.datetime(2024, 1, 1 + int(h[1:]) % 9, 5)
    rows = [("o", repo, h, None, at(h), f"a{len(h + repo) % 3}{int(h[1:]) % 4}", None, f, 1, None) for repo, h, f in sorted(keys)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, CHANGES), [spark.createDataFrame(rows[i::3], CHANGES) for i in range(3)]


def rows(df):
    return sorted(tuple(sorted(r.asDict().items())) for r in df.collect())


FULL = {"author_tenure": A.author_tenure, "file_commit_counts": A.file_commit_counts, "commits_by_date": lambda c: A.commits_by_date(c, "2024-02-01")}


@pytest.mark.parametrize("name", sorted(FULL))
def test_batches_add_up(spark, tmp, name):
    all_, batches = changes(spark, 4)
    args = ("2024-02-01",) if name == "commits_by_date" else ()
    want = rows(FULL[name](all_))
    for order in list(itertools.permutations(range(3)))[::4]:
        state = R.merge(name, *[R.partial(name, batches[i]) for i in order])
        assert rows(R.final(name, state, *args)) == want
    path = os.path.join(tmp, "state")
    for i, b in enumerate(batches, 1):
        R.add_batch(name, b, path, i)
        state = R.add_batch(name, b, path, i)          # the same batch again adds nothing
    assert rows(R.final(name, state, *args)) == want
    with pytest.raises(ValueError):
        R.add_batch(name, batches[0], path, 9)


def test_an_unfinished_version_is_not_read(spark, tmp):
    _, batches = changes(spark, 5)
    path = os.path.join(tmp, "state")
    want = rows(R.add_batch("file_commit_counts", batches[0], path, 1))
    R.partial("file_commit_counts", batches[1]).write.parquet(os.path.join(path, "v=2"))
    os.remove(os.path.join(path, "v=2", "_SUCCESS"))
    assert rows(R.read_state(spark, path)) == want
    state = R.add_batch("file_commit_counts", batches[1], path, 2)
    assert rows(state) == rows(R.merge("file_commit_counts", R.partial("file_commit_counts", batches[0]), R.partial("file_commit_counts", batches[1])))
    # the plan of a batch reads the stored state, not the rows of earlier batches
    assert state._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_tag_totals_add_up(spark):
    tags = spark.createDataFrame([("o", "r", 1, "a"), ("o", "r", 2, "b")], "repo_owner string, repo_name string, tag_id int, name string")
    ct = spark.createDataFrame([("o", "r", i, i % 2 + 1, 0.1 * i) for i in range(30)], "repo_owner string, repo_name string, id long, tag_id int, value double")
    state = R.merge("tag_totals", *[R.partial("tag_totals", ct.filter(f"id % 4 = {i}")) for i in range(4)])
    assert rows(R.final("tag_totals", state, tags)) == rows(G.tag_totals(ct, tags))


def test_shares_of_a_zero_total(spark, tmp):
    # a commit whose weights add up to zero: its rows stay, with the view's
    # quotient, and add nothing to any sum
    import datetime as dt

    import duckdb

    import __spark_entry__ as E
    at = lambda day: dt.datetime(2024, 1, day, 9)
    ev = [(1, at(1), 1, "click", 0.0, '{"k": 1}'), (2, at(1), 2, "click", 2.0, '{"k": 1}'), (3, at(1), 2, "view", 6.0, '{"k": 1}'),
          (4, at(9), 3, "view", 0.0, '{"k": 1}'), (5, at(2), 4, "view", 3.0, '{"k": 1}'), (6, at(2), 4, "click", -3.0, '{"k": 1}')]
    spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp}/events.parquet")
    q = E.queries()
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp}/events.parquet/*.parquet')")
    want = con.execute(E.oracle_sql()["tag_rows"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in q["tag_rows"](spark, tmp).collect()))) == sorted(str(r) for r in want) and len(want) == 3
    totals = {r["name"]: float(r["total_value"]) for r in q["tag_totals"](spark, tmp).collect()}
    assert totals == {"click": 0.25, "view": 0.75} == {r["name"]: float(r["total_value"]) for r in q["rolled_tag_totals"](spark, tmp).collect()}
    week = [(str(r.week_starting), r.tag, float(r.raw), float(r.percentage)) for r in q["tag_share_by_week"](spark, tmp).collect()]
    assert sorted(week) == [("2024-01-01", "click", 0.25, 25.0), ("2024-01-01", "view", 0.75, 75.0), ("2024-01-08", "view", 0.0, 0.0)]
