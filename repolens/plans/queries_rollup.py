"""Registered queries of summaries kept up to date by batches (A2, A4, A6, A7),
of summaries that unchanged data does not write again (U6), and of the column
profile (R9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import REPO
from ..operators import activity as A
from ..operators import catalogue as K
from ..operators import load as U
from ..operators import rollup as R
from ..schemas import CHANGES, PULL_REQUESTS, SUMMARIES
from ..session import scratch_path
from ..sources import fixtures as X
from . import queries_activity, queries_tags  # noqa: F401  (their oracles)
from .registry import ORACLES, query

LONG = X.sql_with(X.SQL_CHANGES_LONG)
CUT = "1996-01-01"


def _tmp(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


def _batches(spark, sf):
    """The changes in three batches; the commits of some hashes come in two
    parts, so a commit's rows are spread over batches."""
    ch = X.changes_long(spark, sf)
    early = F.col("committed_at") < F.lit(CUT).cast("timestamp_ntz")
    part = F.when(early & ~((F.col("churn_count") % 5 == 0) & F.col("commit_hash").startswith("1")), 1).when(early, 2).otherwise(3)
    return [ch.filter(part == i) for i in (1, 2, 3)]


def _rolled(spark, name, batches, *args):
    path = _tmp(spark, "state")
    for i, rows in enumerate(batches, 1):
        state = R.add_batch(name, rows, path, i)
    return R.final(name, state, *args)


@query("rolled_author_tenure", ORACLES["author_tenure"])
def q_rolled_author_tenure(spark, sf):
    return _rolled(spark, "author_tenure", _batches(spark, sf))


@query("rolled_file_commits", ORACLES["file_commit_counts"])
def q_rolled_file_commits(spark, sf):
    return _rolled(spark, "file_commit_counts", _batches(spark, sf))


@query("rolled_commits_by_date", ORACLES["commits_by_date_long"])
def q_rolled_commits_by_date(spark, sf):
    return _rolled(spark, "commits_by_date", _batches(spark, sf), "2001-09-01")


@query("rolled_tag_totals", ORACLES["tag_totals"])
def q_rolled_tag_totals(spark, sf):
    ct = X.event_commit_tags(spark, sf)
    return _rolled(spark, "tag_totals", [ct.filter(F.col("id") % 3 == i) for i in range(3)], X.event_tags(spark, sf))


@query("summaries_if_new", LONG + """, r as (
  select distinct repo_owner, repo_name, repo_name = 'asia' as changed from changes_long),
n as (select * from (values ('author-commits-summary'), ('file-commit-count-summary')) as n(name))
select repo_owner, repo_name, name, case when changed then 2 else 1 end as stored, case when changed then 1 else 0 end as second_run
from r, n""")
def q_summaries_if_new(spark, sf):
    # Data sets are summarised twice, and between the runs only one
    # repository gets new rows: the others' content keys are stored already
    second = F.sum(F.when(F.col("created_at") >= F.lit("2024-01-02").cast("timestamp_ntz"), 1).otherwise(0)).cast("int")
    return (_stored_summaries(spark, sf).groupBy(*REPO, "name")
            .agg(F.count(F.lit(1)).cast("int").alias("stored"), second.alias("second_run")))


def _stored_summaries(spark, sf):
    """The summaries table after two runs over two data sets of five repositories."""
    ch = X.changes_long(spark, sf)
    new = (F.col("repo_name") == "asia") & (F.col("committed_at") >= F.lit(CUT).cast("timestamp_ntz"))
    path = _tmp(spark, "summaries")
    spark.createDataFrame([], SUMMARIES).write.parquet(path)
    for run, rows in ((1, ch.filter(~new)), (2, ch)):
        spans = A.date_span(rows).select(*REPO, F.col("first_date").alias("start_date"), F.col("last_date").alias("end_date"))
        sets = {"author-commits-summary": A.author_tenure(rows), "file-commit-count-summary": A.file_commit_counts(rows)}
        stored = spark.read.schema(SUMMARIES).parquet(path)
        for name, ds in sets.items():
            found = U.save_summary_if_new(stored, U.data_fingerprint(ds).withColumn("name", F.lit(name)))
            found = found.join(spans, list(REPO))
            made = {"ai_service": F.lit("offline"), "ai_model": F.lit("counter"), "summary": F.concat(F.lit("rows: "), F.col("rows").cast("string")), "created_at": F.lit(f"2024-01-0{run}").cast("timestamp_ntz")}
            out = [made.get(f.name, F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SUMMARIES.fields]
            found.select(*out).write.mode("append").parquet(path)
    return spark.read.schema(SUMMARIES).parquet(path)


@query("latest_summary_rows", LONG + """, d as (select repo_owner, repo_name, strftime(min(committed_at), '%Y/%m/%d') as start, strftime(max(committed_at), '%Y/%m/%d') as "end",
  count(distinct author) as authors, count(distinct filename) as files from changes_long group by 1, 2)
select repo_owner, repo_name, 'author-commits-summary' as name, concat('rows: ', authors) as summary, 'offline' as ai_service, 'counter' as ai_model, start, "end" from d
union all select repo_owner, repo_name, 'file-commit-count-summary', concat('rows: ', files), 'offline', 'counter', start, "end" from d""")
def q_latest_summary_rows(spark, sf):
    # Of the summaries stored by two runs the latest of each
    # repository and data set, with its dates for display
    return U.summary_for_display(_stored_summaries(spark, sf))


def _profile_sql() -> str:
    """Counts per column; columns that the view lacks are NULL in every row."""
    views = {"changes": ("changes_long", CHANGES, {"epoch", "email"}),
             "pull_requests": ("pulls", PULL_REQUESTS, {"mergeable", "mergeable_state", "comments", "review_comments"})}
    text = lambda t: "'" + t.replace("'", "''") + "'"
    parts = []
    for table, (view, schema, absent) in views.items():
        for f in schema.fields:
            filled = "cast(0 as bigint)" if f.name in absent else f"count({f.name})"
            parts.append(f"""select '{table}' as "table", count(*) as rows, '{f.name}' as "column", {text(f.dataType.simpleString())} as type,
  {text(f.metadata['meaning'])} as meaning, {filled} as filled from {view}""")
    return X.sql_with(X.SQL_CHANGES_LONG, X.SQL_PULL_REQUESTS) + "\nunion all ".join(parts)


@query("schema_profile", _profile_sql())
def q_schema_profile(spark, sf):
    # Every column of two tables with its meaning and how many rows fill it
    return K.profile("changes", X.changes_long(spark, sf)).unionByName(K.profile("pull_requests", X.pull_requests(spark, sf)))
