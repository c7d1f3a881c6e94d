"""Operator unit tests on small literal tables, one case per defect row
"""

import datetime as dt

from pyspark.sql import functions as F

from repolens.operators import activity as A
from repolens.operators import churn as C
from repolens.operators import load as U
from repolens.operators import pulls as P
from repolens.operators import tags as G
from repolens.operators import code_metrics as M

SCHEMA = ("repo_owner string, repo_name string, commit_hash string, committed_at timestamp_ntz, "
          "author string, filename string, churn_count bigint, description string")


def ch(spark, rows):
    return spark.createDataFrame([("o", "r") + r for r in rows], SCHEMA)


def d(y, m, day, h=12):
    return dt.datetime(y, m, day, h)


def test_author_commits_top_n_ties_and_since(spark):
    c = ch(spark, [("h1", d(2024, 1, 1), "b", "x", 1, None), ("h1", d(2024, 1, 1), "b", "y", 1, None),
                   ("h2", d(2024, 1, 2), "a", "x", 1, None), ("h3", d(2024, 1, 3), "c", "x", 1, None),
                   ("h4", d(2024, 1, 4), "c", "x", 1, None)])
    got = [(r.author, r.commits) for r in A.author_commits(c, n=2).orderBy(F.desc("commits"), "author").collect()]
    assert got == [("c", 2), ("a", 1)]  # a and b tie at 1: name order breaks it (D14)
    got = {r.author for r in A.author_commits(c, since_mdy="01/03/2024").collect()}
    assert got == {"c"}


def test_author_tenure_counts_file_rows(spark):
    c = ch(spark, [("h1", d(2024, 1, 1), "a", "x", 1, None), ("h1", d(2024, 1, 1), "a", "y", 1, None),
                   ("h2", d(2024, 1, 5), "a", "x", 1, None)])
    r = A.author_tenure(c).collect()[0]
    assert (r.total_file_commits, r.first_commit_date, r.last_commit_date) == (3, d(2024, 1, 1), d(2024, 1, 5))


def test_file_commits_described_only(spark):
    c = ch(spark, [("h1", d(2024, 1, 1), "a", "x", 1, "t"), ("h2", d(2024, 1, 2), "a", "x", 1, None),
                   ("h3", d(2024, 1, 2), "a", "y", 1, None)])
    assert {(r.filename, r.commits) for r in A.file_commits(c).collect()} == {("x", 1)}
    assert {(r.filename, r.commit_count) for r in A.file_commit_counts(c).collect()} == {("x", 2), ("y", 1)}


def test_commits_over_time_day_spine_no_gaps(spark):
    c = ch(spark, [("h1", d(2024, 1, 1), "a", "x", 1, None), ("h2", d(2024, 1, 4), "a", "y", 1, None),
                   ("h2", d(2024, 1, 4), "a", "z", 1, None)])
    rows = A.commits_over_time(c).orderBy("date").collect()
    assert [r.type for r in rows] == ["Day"] * 4
    assert [(r.date.day, r.commits, r.files) for r in rows] == [(1, 1, 1), (2, 0, 0), (3, 0, 0), (4, 1, 2)]


def test_commits_over_time_week_sums_daily_values(spark):
    # > 90 days: Monday weeks holding the sum of the daily values
    c = ch(spark, [("h1", d(2024, 1, 2), "a", "x", 1, None), ("h2", d(2024, 1, 3), "a", "x", 1, None),
                   ("h3", d(2024, 6, 1), "a", "y", 1, None)])
    rows = A.commits_over_time(c).orderBy("date").collect()
    assert rows[0].type == "Week" and rows[0].date == dt.date(2024, 1, 1)
    assert (rows[0].commits, rows[0].files) == (2, 2)      # file x counted on both days
    dates = [r.date for r in rows]
    assert all((b - a).days == 7 for a, b in zip(dates, dates[1:]))
    assert rows[-1].date == dt.date(2024, 5, 27) and rows[-1].commits == 1


def test_commits_by_date_file_count_rule(spark):
    # a file touched by two commits of the day counts twice
    c = ch(spark, [("h1", d(2024, 1, 1), "a", "x", 1, None), ("h2", d(2024, 1, 1), "a", "x", 1, None),
                   ("h2", d(2024, 1, 1), "a", "y", 1, None)])
    r = A.commits_by_date(c, "2024-01-11").collect()[0]
    assert (r.commit_count, r.file_count, r.days_ago) == (2, 3, 10)


def test_churn_tree_root_and_file_dir_clash(spark):
    c = ch(spark, [("h1", d(2024, 1, 1), "a", "src/a.py", 5, "t"), ("h2", d(2024, 1, 1), "a", "src/b/c.py", 7, "t"),
                   ("h3", d(2024, 1, 1), "a", "src/b", 2, "t"), ("h4", d(2024, 1, 1), "a", "x.py", 9, None)])
    rows = {(r.path, r.is_file): r for r in C.churn_tree(c).collect()}
    assert rows[("", False)].churn == 14 and rows[("", False)].name == "repo"
    assert rows[("src", False)].churn == 14 and rows[("src", False)].color == "#D98943"
    assert rows[("src/b", True)].churn == 2 and rows[("src/b", False)].churn == 7   # D13
    assert rows[("src/b/c.py", True)].parent == "src/b" and rows[("src/b/c.py", True)].depth == 3
    files = sum(r.churn for r in rows.values() if r.is_file)
    assert files == rows[("", False)].churn       # property: root = sum of file churn


def test_directory_commits_rename_and_levels(spark):
    c = ch(spark, [("h1", d(2024, 1, 1), "a", "a/{old => new}/x.py", 1, None),
                   ("h2", d(2024, 1, 1), "a", "a/old/y.py", 1, None)])
    got = {(r.directory, r.commits) for r in C.directory_commits(c).collect()}
    assert got == {("a/old", 2)}
    assert {(r.directory, r.commits) for r in C.directory_commits(c, levels=1).collect()} == {("a", 2)}


def test_insert_new_first_wins_and_idempotent(spark):
    keys = ["repo_owner", "repo_name", "commit_hash", "filename"]
    target = ch(spark, [("h1", d(2024, 1, 1), "a", "x", 1, None)])
    batch = ch(spark, [("h1", d(2024, 1, 1), "a", "x", 9, None), ("h2", d(2024, 1, 2), "a", "x", 2, None),
                       ("h2", d(2024, 1, 2), "a", "x", 3, None)]).withColumn("pos", F.monotonically_increasing_id())
    new = U.insert_new(target, batch, keys, ["pos"]).drop("pos")
    assert [(r.commit_hash, r.churn_count) for r in new.collect()] == [("h2", 2)]
    once = target.unionByName(new)
    again = U.insert_new(once, batch, keys, ["pos"])
    assert again.count() == 0      # property: running the load twice = once


def test_update_by_key_and_not_found(spark):
    t = ch(spark, [("h1", d(2024, 1, 1), "a", "x", 1, None), ("h2", d(2024, 1, 1), "a", "y", 1, "old")])
    upd = spark.createDataFrame([("o", "r", "h2", "y", "new"), ("o", "r", "h9", "z", "lost")],
                                "repo_owner string, repo_name string, commit_hash string, filename string, description string")
    keys = ["repo_owner", "repo_name", "commit_hash", "filename"]
    got = {r.commit_hash: r.description for r in U.update_by_key(t, upd, keys, ["description"]).collect()}
    assert got == {"h1": None, "h2": "new"}
    assert [r.commit_hash for r in U.not_found(t, upd, keys).collect()] == ["h9"]


def test_latest_summary_and_save_if_new(spark):
    s = spark.createDataFrame([("o", "r", "n", "h1", "old", d(2024, 1, 1)), ("o", "r", "n", "h2", "new", d(2024, 2, 1))],
                              "repo_owner string, repo_name string, name string, hash string, summary string, created_at timestamp_ntz")
    assert U.latest_summary(s, "n").collect()[0].summary == "new"
    assert U.latest_summary(s, "missing").count() == 0          # D12: no row, not an error
    cand = spark.createDataFrame([("o", "r", "n", "h2"), ("o", "r", "n", "h3")],
                                 "repo_owner string, repo_name string, name string, hash string")
    assert [r.hash for r in U.save_summary_if_new(s, cand).collect()] == ["h3"]


def test_fingerprint_order_insensitive(spark):
    a = spark.createDataFrame([("o", "r", 1, "x"), ("o", "r", 2, "y")], "repo_owner string, repo_name string, k int, v string")
    b = spark.createDataFrame([("o", "r", 2, "y"), ("o", "r", 1, "x")], "repo_owner string, repo_name string, k int, v string")
    c = spark.createDataFrame([("o", "r", 2, "z"), ("o", "r", 1, "x")], "repo_owner string, repo_name string, k int, v string")
    fa, fb, fc = (U.data_fingerprint(x).collect()[0].hash for x in (a, b, c))
    assert fa == fb != fc


TAGS = "repo_owner string, repo_name string, tag_id int, name string"
CT = "repo_owner string, repo_name string, id int, tag_id int, value double"
CH = "repo_owner string, repo_name string, id int, committed_at timestamp_ntz"


def test_tag_totals_other_and_weekly(spark):
    tags = spark.createDataFrame([("o", "r", i, n) for i, n in enumerate("ABCD", 1)], TAGS)
    ct = spark.createDataFrame([("o", "r", 1, 1, 0.5), ("o", "r", 1, 2, 0.5), ("o", "r", 2, 3, 0.125),
                                ("o", "r", 2, 4, 0.875)], CT)
    chg = spark.createDataFrame([("o", "r", 1, d(2024, 1, 2)), ("o", "r", 2, d(2024, 1, 16))], CH)
    tot = {r.name: float(r.total_value) for r in G.tag_totals(ct, tags).collect()}
    assert tot == {"A": 0.5, "B": 0.5, "C": 0.13, "D": 0.88}     # HALF_UP on decimals (D16)
    other = {r.name: float(r.total_value) for r in G.tag_totals(ct, tags, include_all=False, n=2).collect()}
    assert other == {"D": 0.88, "A": 0.5, "Other": 0.63}           # sum of rounded rest (D15)
    wk = G.tags_by_week(ct, tags, chg, ["id"], as_of="2024-01-30").orderBy("week_starting", "tag").collect()
    assert [w.week for w in wk] == ["2024-01", "2024-01", "2024-02", "2024-03", "2024-03", "2024-04", "2024-05"]
    assert wk[2].tag is None                                       # empty week kept (D8 spine)
    m = {r.tag: [float(x) for x in r.weekly_percentage]
         for r in G.tag_share_matrix(ct, tags, chg, ["id"], as_of="2024-01-30").collect()}
    assert m["A"] == [50.0, 0.0, 0.0, 0.0, 0.0] and m["D"] == [0.0, 0.0, 87.5, 0.0, 0.0]
    assert all(len(v) == 5 for v in m.values())                    # property: spine length


def test_normalised_weights_sum_to_one(spark):
    w = spark.createDataFrame([("o", "r", i % 7, f"t{i % 5}", i % 9) for i in range(200)],
                              "repo_owner string, repo_name string, id int, tag string, weight int")
    w = w.groupBy("repo_owner", "repo_name", "id", "tag").agg(F.max("weight").alias("weight"))
    s = G.normalise(w, ["id"]).groupBy("id").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-12 for r in s)


def test_pairs_are_not_dealt_by_their_tag(spark):
    # all pairs of a tag would meet in one task, sorted
    resp = spark.range(40).select(F.lit("o").alias("repo_owner"), F.lit("r").alias("repo_name"), "id", F.lit("A,1,B,2,A,3,C,x").alias("response"))
    tags = spark.createDataFrame([("o", "r", i, n) for i, n in enumerate("AB", 1)], TAGS)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parsed = G.parse_tags(resp, tags, ["id"])
        plan = parsed._jdf.queryExecution().executedPlan().toString()
        got = {(r.id, r.tag, r.weight) for r in parsed.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "SortMergeJoin" not in plan and got == {(i, t, n) for i in range(40) for t, n in (("A", 3), ("B", 2))}


def test_a_task_gets_little_shuffled_data(spark):
    from repolens.session import TASK_SHUFFLE, ensure_query_conf
    key = TASK_SHUFFLE[0]
    spark.conf.unset(key)
    ensure_query_conf(spark)
    assert spark.conf.get(key) == "16m"
    spark.conf.set(key, "5m")
    try:
        ensure_query_conf(spark)                        # what the cluster says holds
        assert spark.conf.get(key) == "5m"
    finally:
        spark.conf.unset(key)


def test_tags_dim_insert_or_ignore(spark):
    repos = spark.createDataFrame([("o", "r")], "repo_owner string, repo_name string")
    base = G.tags_dim(" API, Docs ,API", repos)
    assert sorted((r.tag_id, r.name) for r in base.collect()) == [(1, "API"), (2, "Docs")]
    more = G.tags_dim("Docs, Testing", repos, existing=base)
    assert sorted((r.tag_id, r.name) for r in more.collect()) == [(1, "API"), (2, "Docs"), (3, "Testing")]


def test_recent_pulls_and_pr_text(spark):
    prs = spark.createDataFrame(
        [("o", "r", 1, "t1", "u", "closed", True, d(2024, 1, 5), d(2024, 1, 5), "h1", None, "1. a\n2. b"),
         ("o", "r", 2, "t2", "u", "open", False, None, None, "h2", None, None)],
        "repo_owner string, repo_name string, number bigint, title string, user_login string, state string, "
        "merged boolean, merged_at timestamp_ntz, closed_at timestamp_ntz, merge_commit_sha string, "
        "html_url string, description string").withColumn(
        "created_at", F.when(F.col("number") == 1, F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")))
    c = ch(spark, [("h1", d(2024, 1, 1), "a", "y", 1, "dy"), ("h1", d(2024, 1, 1), "a", "x", 1, "dx"),
                   ("h2", d(2024, 1, 1), "a", "z", 1, None)])
    rp = {r.pr_number: r for r in P.recent_pulls(prs, c).collect()}
    assert rp[1].file_count == 2 and rp[1].week_str == "2024-01"
    assert rp[1].description == "&nbsp;&#8226;&nbsp;a<BR>&nbsp;&#8226;&nbsp;b"
    assert rp[2].date is None and rp[2].week_str is None and rp[2].description is None   # D10
    assert set(rp) == {1, 2}
    assert [r.pr_number for r in P.recent_pulls(prs, c, since_mdy="01/01/2024").collect()] == [1]
    txt = {r.number: r.text for r in P.pr_text(prs, c).collect()}
    assert txt == {2: ""}           # PR 1 already has a description; PR 2's changes have none
    prs2 = prs.withColumn("description", F.lit(None).cast("string"))
    txt = {r.number: r.text for r in P.pr_text(prs2, c).collect()}
    assert txt == {1: "dx\n--\ndy", 2: ""}
    assert float(P.merge_hours(prs).collect()[0][2]) == 48.0     # 2024-01-03 12:00 -> 01-05 12:00


def test_composite_in_unit_interval_and_file_means(spark):
    f = spark.createDataFrame(
        [("o", "r", "a.py", "function", "f", 10, 2, 1, 3, 4, 0.5), ("o", "r", "a.py", "function", "g", 5, 1, 0, 0, 2, 0.0),
         ("o", "r", "b.py", "class", "K", 50, None, None, None, None, None),
         ("o", "r", "c.py", "function", "h", 0, 0, 0, 0, 0, 0.0)],
        "repo_owner string, repo_name string, file_path string, type string, name string, lines_of_code int, "
        "cyclomatic_complexity int, nesting_depth int, number_of_function_calls int, number_of_variables int, "
        "llm_code_readability double")
    sc = {r.name: r.composite_complexity for r in M.composite_complexity(f).collect()}
    assert sc["K"] is None
    assert abs(sc["f"] - (0.2 + 0.15 + 0.15 + 0.15 + 0.15 + 0.1)) < 1e-12
    assert all(v is None or 0 <= v <= 1 for v in sc.values())       # property: in [0, 1]
    fc = {r.file_path: float(r.avg_complexity) for r in M.file_complexity(M.composite_complexity(f)).collect()}
    assert fc["c.py"] == 0.0 and fc["b.py"] == 0.0
    assert abs(fc["a.py"] - round((sc["f"] + sc["g"]) / 2, 4)) < 1e-9


def test_file_metrics_in_one_aggregate(spark):
    rows = [("o", "r", f, n, "function", c, 5, 1, 1, 2, 3) for f, n, c in [("a.py", "g", 0.5), ("a.py", "f", 0.25), ("a.py", "z", 0.0), ("b.py", "h", None)]]
    scored = spark.createDataFrame(rows, "repo_owner string, repo_name string, file_path string, name string, type string, composite_complexity double, "
                                         "lines_of_code int, cyclomatic_complexity int, nesting_depth int, number_of_variables int, number_of_function_calls int")
    out = M.file_metrics(scored)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {r.file_path: (float(r.avg_complexity), [f.function_name for f in r.functions]) for r in out.collect()}
    assert got == {"a.py": (0.375, ["f", "g", "z"]), "b.py": (0.0, ["h"])}
    assert {r.file_path: float(r.avg_complexity) for r in M.file_complexity(scored).collect()} == {"a.py": 0.375, "b.py": 0.0}
