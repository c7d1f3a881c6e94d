"""Registered queries of incremental work: runs steered by the run log (S11),
rebuilding one repository (U7), the describe chain (L2-L4, U3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import REPO
from ..operators import runs as R
from ..operators import work as W
from ..schemas import CHANGES
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as X
from ..sources import logs as LG
from .registry import query

LONG = X.sql_with(X.SQL_CHANGES_LONG)
ROW = [*REPO, "commit_hash", "committed_at", "author", "filename", "churn_count"]


def _tmp(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


def _day(text):
    return F.lit(text).cast("timestamp_ntz")


@query("incremental_runs", LONG + f"""select {', '.join(ROW)} from changes_long""")
def q_incremental_runs(spark, sf):
    # The first run takes what was there on 1997-06-01, without some
    # commits of the fortnight before, which come late; the second run reads
    # from its mark less 30 days; together they are one full load
    source, target, log = _tmp(spark, "source"), _tmp(spark, "changes"), _tmp(spark, "runs")
    (X.changes_long(spark, sf).select(*[f.name for f in CHANGES.fields])
     .write.partitionBy(*REPO).parquet(source))
    ch = spark.read.schema(CHANGES).parquet(source)
    late = (F.col("committed_at") >= _day("1997-05-18")) & F.col("commit_hash").startswith("0")
    R.run_incremental(ch.filter((F.col("committed_at") < _day("1997-06-01")) & ~late), target, log, "1997-06-01T00:00:00", ["commit_hash"])
    R.run_incremental(ch, target, log, "2001-01-01T00:00:00", ["commit_hash"], late_days=30)
    return spark.read.schema(CHANGES).parquet(target).select(*ROW)


@query("last_runs", LONG + """, d as (select repo_owner, repo_name, max(committed_at) as m from changes_long group by 1, 2)
select repo_owner, repo_name, strftime(m, '%m/%d/%Y') as last_run from d""")
def q_last_runs(spark, sf):
    # One log line per repository and year of activity, and other keys
    # and malformed lines; the last completed run of each repository
    log = _tmp(spark, "runs")
    ch = X.changes_long(spark, sf)
    per_year = ch.groupBy(*REPO, F.year("committed_at").alias("y")).agg(F.max("committed_at").alias("m"))
    iso = F.date_format("m", "yyyy-MM-dd'T'HH:mm:ss")
    for key, value in (("last_completed", iso), ("last_started", F.lit("2030-01-01T00:00:00")), ("last_completed", F.lit("soon"))):
        LG.append_runs(per_year.select(*REPO, F.lit(key).alias("key"), value.alias("value")), log)
    LG.append_runs(per_year.select("repo_owner", "repo_name", F.lit("last_completed").alias("key"), F.lit("2031-01-01T00:00:00\tx").alias("value")), log)
    return LG.last_run(LG.read_run_log(spark, log))


@query("rebuild_one_repository", LONG + f"""select {', '.join(ROW)} from changes_long
where repo_name not in ('asia', 'africa') or (repo_name = 'asia' and committed_at >= timestamp '1996-01-01')""")
def q_rebuild_one_repository(spark, sf):
    # All five repositories are loaded, then one is rebuilt from its
    # younger rows and one is rebuilt to nothing; the others stay
    path = _tmp(spark, "changes")
    ch = X.changes_long(spark, sf).select(*[f.name for f in CHANGES.fields])
    R.rebuild(ch, path)
    young = ch.filter((F.col("repo_name") == "asia") & (F.col("committed_at") >= _day("1996-01-01")))
    R.rebuild(young, path, repos=[("tpch", "asia"), ("tpch", "africa")])
    return spark.read.schema(CHANGES).parquet(path).select(*ROW)


MAX_LEN = 40


class LineModel:
    """A stand-in model whose answers SQL can state: garbage about anvils, the
    text four times over about rings and eighty times about widgets, else
    the text itself; asked to shorten a text, it gives back the first half."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            _, kind, text = p.split("\n", 2)
            if kind.startswith("Shorten"):
                out.append(text[:len(text) // 2])
            elif "anvil" in text:
                out.append("@@@ " + text)
            else:
                out.append(text * (80 if "widget" in text else 4 if "ring" in text else 1))
        return out


@query("describe_changes", LONG + f""", t as (
  select *, case when churn_count % 11 = 0 then null when churn_count % 3 = 0 then 'content' else 'diff' end as source,
    case when churn_count % 3 = 0 then replace(filename, ' ', '.') else '+' || replace(filename, ' ', '_') end as data
  from changes_long where description is null),
l as (
  select *, (case when data like '%widget%' then 80 when data like '%ring%' then 4 else 1 end) as k,
    length(data) * (case when data like '%widget%' then 80 when data like '%ring%' then 4 else 1 end) as n from t),
h as (
  select *, case when n <= {MAX_LEN} then 0 when n // 2 <= {MAX_LEN} then 1 when n // 4 <= {MAX_LEN} then 2 when n // 8 <= {MAX_LEN} then 3
    when n // 16 <= {MAX_LEN} then 4 when n // 32 <= {MAX_LEN} then 5 end as h from l)
select repo_owner, repo_name, commit_hash, filename, source,
  case when source is null or data like '%anvil%' or h is null then 'rejected' else 'described' end as state,
  case when source is null then 'no diff and no content' when data like '%anvil%' then 'no usable answer'
    when h is null then 'never short enough' end as reason,
  case when source is not null and data not like '%anvil%' then substr(repeat(data, cast(k as bigint)), 1, cast(n // (1 << h) as bigint)) end as description
from h""")
def q_describe_changes(spark, sf):
    # The undescribed changes of code files with their diffs or
    # contents, through all states, written back to the changes
    # computed once: the work, its sources and the write-back read it, and
    # none of them asks for a change that has a description
    ch = cut_lineage(X.changes_long(spark, sf).filter("description is null").select(*W.KEYS, "churn_count", "description"))
    n = F.col("churn_count")
    sources = ch.select(*W.KEYS, F.when((n % 11 != 0) & (n % 3 != 0), F.concat(F.lit("+"), F.replace("filename", F.lit(" "), F.lit("_")))).alias("diff"),
                        F.when((n % 11 != 0) & (n % 3 == 0), F.replace("filename", F.lit(" "), F.lit("."))).alias("content"))
    work = cut_lineage(W.run_work(W.describe_work(ch, sources), LineModel(), _tmp(spark, "store"), max_len=MAX_LEN).drop("data"))
    described = W.write_back(ch, work).select(*W.KEYS, "description")
    return work.select(*W.KEYS, "source", "state", "reason").join(described, W.KEYS)
