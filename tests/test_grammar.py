"""Grammar tests for the text sources (S1, S3, S4, S6, S7, S9, S11) and the
tag-response parser (G1/G2) on the samples of FIXTURES.md."""

import datetime as dt
import os

from pyspark.sql import functions as F

from repolens.operators import tags as G
from repolens.sources import commit_log as S1
from repolens.sources import description_log as S4
from repolens.sources import logs as L
from repolens.sources import pull_requests as S3
from repolens.sources.source_files import filter_ignored, gitignore_regex

LOG = ("^^a1--1722254400.0--2024-07-29T12:00:00+00:00--Ann--ann@x.org--first  commit\n"
       "10\t2\tsrc/app.py\n"
       "-\t\tassets/logo.png\n\n"
       "^^b2--1722340800.0--2024-07-30T12:00:00-07:00--dependabot[bot]--d@x.org--bump\n"
       "1\t1\tpackage.lock\n\n"
       "^^bad--record\n"
       "^^c3--1722427200.0--2024-07-31T12:00:00+00:00--Bob--bob@x.org--m\n"
       "5\tsrc/only_two_fields\n"
       "3\t4\tsrc/app.py\n")


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_commit_log_rows_and_rejects(spark, tmp):
    p = _write(tmp, "log.txt", LOG)
    ch, rej = S1.read_commit_log(spark, p, "o", "r", exclude_authors="dependabot|github")
    got = sorted((r.commit_hash, r.epoch, r.committed_at, r.author, r.email, r.filename, r.churn_count)
                 for r in ch.collect())
    assert got == [
        ("a1", 1722254400.0, dt.datetime(2024, 7, 29, 12), "Ann", "ann@x.org", "assets/logo.png", 0),
        ("a1", 1722254400.0, dt.datetime(2024, 7, 29, 12), "Ann", "ann@x.org", "src/app.py", 12),
        ("c3", 1722427200.0, dt.datetime(2024, 7, 31, 12), "Bob", "bob@x.org", "src/app.py", 7),
    ]
    rj = sorted((r.kind, r.text) for r in rej.collect())
    assert rj == [("line", "5\tsrc/only_two_fields"), ("record", "bad--record")]


def test_commit_log_empty_author_pattern_keeps_all(spark, tmp):
    p = _write(tmp, "log.txt", LOG)
    ch, _ = S1.read_commit_log(spark, p, "o", "r", exclude_authors="")
    assert "b2" in {r.commit_hash for r in ch.collect()}


def test_commit_log_file_pattern_case_insensitive(spark, tmp):
    p = _write(tmp, "log.txt", LOG)
    ch, _ = S1.read_commit_log(spark, p, "o", "r", exclude_files=r"\.PNG")
    assert "assets/logo.png" not in {r.filename for r in ch.collect()}


def test_commit_log_partitioned_layout(spark, tmp):
    d = os.path.join(tmp, "repo_owner=acme", "repo_name=tool")
    os.makedirs(d)
    _write(d, "log.txt", LOG)
    ch, _ = S1.read_commit_log(spark, tmp)
    assert {(r.repo_owner, r.repo_name) for r in ch.collect()} == {("acme", "tool")}


PR_TSV = ("number\ttitle\tuser_login\tstate\tcreated_at\tmerged\tmerged_at\tmerge_commit_sha\t"
          "mergeable\tmergeable_state\tcomments\treview_comments\tclosed_at\thtml_url\tdescription\n"
          "1\tAdd x\tann\topen\t2024-07-01 10:00:00+00:00\tFalse\tNone\tNone\tNone\tunknown\t0\t0\tNone\tu1\n"
          "2\tFix  y\tbob\tclosed\t2024-07-02 10:00:00+00:00\tFalse\tNone\tabc\tNone\tunknown\t1\t0\t2024-07-03 10:00:00+00:00\tu2\n"
          "3\tShip z\tann\tclosed\t2024-07-04 10:00:00+00:00\tTrue\t2024-07-05 11:30:00+00:00\tdef\tNone\tunknown\t2\t3\t2024-07-05 11:30:00+00:00\tu3\n")


def test_pull_request_dump(spark, tmp):
    p = _write(tmp, "prs.txt", PR_TSV)
    rows = {r.number: r for r in S3.read_pull_requests(spark, p, "o", "r").collect()}
    assert rows[1].state == "open" and rows[1].merged is False and rows[1].merged_at is None
    assert rows[1].merge_commit_sha is None and rows[1].description is None
    assert rows[2].closed_at == dt.datetime(2024, 7, 3, 10) and rows[2].merged is False
    assert rows[3].merged is True and rows[3].merged_at == dt.datetime(2024, 7, 5, 11, 30)
    assert rows[3].comments == 2 and rows[3].review_comments == 3


DESC_LOG = ("junk before the first record\n"
            "2024-08-01 10:00:00\tsrc/app.py\ta1\tfirst line\n"
            "second line\n"
            "2024-08-02 10:00:00\tsrc/app.py\ta1\tnewer text\n"
            "2024-08-02 10:00:00\tsrc/app.py\ta1\tsame time, later line\n"
            "2024-08-03 09:00:00\tsrc/b.py\tb2\tmulti\n\tline with tab\n")


def test_description_log_records(spark, tmp):
    p = _write(tmp, "d.txt", DESC_LOG)
    recs = S4.read_description_log(spark, p, "o", "r").orderBy("position").collect()
    assert [r.text for r in recs] == ["first line\nsecond line", "newer text",
                                      "same time, later line", "multi\n\tline with tab"]
    assert recs[0].logged_at == dt.datetime(2024, 8, 1, 10)


def test_backfill_latest_wins_and_ties_keep_earlier(spark, tmp):
    from repolens.operators.load import backfill_descriptions
    p = _write(tmp, "d.txt", DESC_LOG)
    log = S4.read_description_log(spark, p, "o", "r")
    ch = spark.createDataFrame(
        [("o", "r", "a1", "src/app.py", None), ("o", "r", "b2", "src/b.py", "kept")],
        "repo_owner string, repo_name string, commit_hash string, filename string, description string")
    got = {r.commit_hash: r.description for r in backfill_descriptions(ch, log).collect()}
    assert got == {"a1": "newer text", "b2": "kept"}
    assert backfill_descriptions(ch, log, enabled=False).filter("description is null").count() == 1


def test_cost_log_and_pricing(spark, tmp):
    p = _write(tmp, "cost.txt", "#date\tmodel\tinput\toutput\tcost\n"
               "2024-07-01\topenai-gpt-4o-mini\t100\t50\t0.5\n"
               "short\trow\n"
               "2024-07-02\topenai-gpt-4o-mini\t10\t5\t0.25\n")
    assert float(L.cost_to_date(L.read_cost_log(spark, p)).collect()[0][0]) == 0.75
    j = _write(tmp, "p.json", '{"openai": {"m1": {"input": 0.15, "output": 0.6}},'
               ' "ollama": {"m2": {"input": 0.0, "output": 0.0}}}')
    rows = {(r.service, r.model): (r.input, r.output) for r in L.read_pricing(spark, j).collect()}
    assert rows == {("openai", "m1"): (0.15, 0.6), ("ollama", "m2"): (0.0, 0.0)}


def test_run_log_last_completed(spark, tmp):
    p = _write(tmp, "runs.txt", "a\tb\tlast_started\t2024-07-01T10:00:00\n"
               "a\tb\tlast_completed\t2024-07-01T11:00:00\n"
               "bad line\n"
               "a\tb\tlast_completed\t2024-07-09T11:00:00\n"
               "c\td\tlast_started\t2024-07-01T10:00:00\n")
    got = {(r.repo_owner, r.repo_name): r.last_run for r in L.last_run(L.read_run_log(spark, p)).collect()}
    assert got == {("a", "b"): "07/09/2024"}


def test_ignore_patterns(spark):
    files = spark.createDataFrame([(p,) for p in [
        "app.py", "build/out.js", "src/build/x.py", "logs/a.log", "keep.log", ".git/config",
        "docs/readme.md", "node_modules/m/index.js", "src/deep/a.tmp"]], "rel_path string")
    pats = ["# comment", "", "/build/", "*.log", "!keep.log", "node_modules", "src/**/*.tmp"]
    got = sorted(r.rel_path for r in filter_ignored(files, pats).collect())
    assert got == ["app.py", "docs/readme.md", "keep.log", "src/build/x.py"]
    assert gitignore_regex("# x") is None


def _tags(spark, names):
    return spark.createDataFrame([("o", "r", i + 1, n) for i, n in enumerate(names)],
                                 "repo_owner string, repo_name string, tag_id int, name string")


def test_tag_response_parse_and_normalise(spark):
    resp = spark.createDataFrame(
        [("o", "r", 1, "API, 5,Bogus,3,Docs,2"), ("o", "r", 2, "API,x,Docs,4,Docs,6"),
         ("o", "r", 3, "API"), ("o", "r", 4, "API,0")],
        "repo_owner string, repo_name string, id int, response string")
    parsed = G.parse_tags(resp, _tags(spark, ["API", "Docs"]), ["id"])
    got = sorted((r.id, r.tag, round(r.value, 6)) for r in G.normalise(parsed, ["id"]).collect())
    assert got == [(1, "API", round(5 / 7, 6)), (1, "Docs", round(2 / 7, 6)), (2, "Docs", 1.0)]


def test_description_log_across_file_splits(spark, tmp):
    # tiny splits: records and their continuation lines cross split borders
    recs = []
    for i in range(40):
        body = "\n".join(f"line {j} of record {i}" for j in range(i % 4 + 1))
        recs.append(f"2024-08-{1 + i % 28:02d} 10:00:{i % 60:02d}\tf{i}.py\th{i}\t{body}")
    p = _write(tmp, "big.txt", "preamble without a record\n" + "\n".join(recs) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        lines = spark.read.text(p)
        assert lines.rdd.getNumPartitions() > 10
        got = {r.commit_hash: r.text for r in S4.read_description_log(spark, p, "o", "r").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 40
    for i in range(40):
        assert got[f"h{i}"] == "\n".join(f"line {j} of record {i}" for j in range(i % 4 + 1))


def test_commit_log_across_file_splits(spark, tmp):
    recs = []
    for i in range(30):
        files = "\n".join(f"{j}\t1\tsrc/m{j}.py" for j in range(i % 3 + 1))
        recs.append(f"^^c{i}--{i}.0--2024-07-29T12:00:00+00:00--A{i}--a@x--msg {i}\n{files}\n")
    p = _write(tmp, "big.txt", "\n".join(recs))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "80")
    try:
        ch, rej = S1.read_commit_log(spark, p, "o", "r")
        rows = ch.collect()
        assert rej.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == sum(i % 3 + 1 for i in range(30))
    assert {(r.commit_hash, r.filename): r.churn_count for r in rows}[("c5", "src/m2.py")] == 3
