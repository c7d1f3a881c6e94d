"""Registered pull-request and incremental-load queries
(O2, O6, J4, A17, T7, K8-K12, U1, U3, U5, J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import REPO
from ..operators import load as U
from ..operators import pulls as P
from ..sources import fixtures as X
from .params import K4_AS_OF, LONG_AS_OF, LONG_SINCE, LONG_SINCE_TS
from .registry import query

PL = X.sql_with(X.SQL_CHANGES_LONG, X.SQL_PULL_REQUESTS)
PR = X.sql_with(X.SQL_PULL_REQUESTS)
LONG = X.sql_with(X.SQL_CHANGES_LONG)


def _recent_sql(where: str) -> str:
    return PL + f""", files as (
  select repo_owner, repo_name, commit_hash, count(filename) as f from changes_long group by 1, 2, 3),
g as (
  select p.repo_owner, p.repo_name, p.number, p.title, p.html_url, p.user_login, p.description,
    p.merged_at, cast(sum(f.f) as bigint) as file_count, cast(p.merged_at as date) as date
  from pulls p join files f on p.repo_owner = f.repo_owner and p.repo_name = f.repo_name
    and p.merge_commit_sha = f.commit_hash {where}
  group by 1, 2, 3, 4, 5, 6, 7, 8)
select repo_owner, repo_name, number as pr_number, file_count, title as pr_title, html_url as pr_url,
  date, case when date is not null then printf('%d-%02d', isoyear(date), week(date)) end as week_str,
  user_login as user,
  regexp_replace(replace(description, chr(10), '<BR>'), '[1-9]\\. ', '&nbsp;&#8226;&nbsp;', 'g') as description
from (select *, row_number() over (partition by repo_owner, repo_name
        order by date desc nulls last, number desc) as rn from g) t where rn <= 10"""


@query("recent_pulls", _recent_sql(""))
def q_recent_pulls(spark, sf):
    return P.recent_pulls(X.pull_requests(spark, sf), X.changes_long(spark, sf))


@query("recent_pulls_since", _recent_sql(f"where p.closed_at >= timestamp '{LONG_SINCE_TS}'"))
def q_recent_pulls_since(spark, sf):
    return P.recent_pulls(X.pull_requests(spark, sf), X.changes_long(spark, sf),
                          since_mdy=LONG_SINCE)


@query("pr_text", PL + """, und as (
  select distinct repo_owner, repo_name, merge_commit_sha, number from pulls where description is null),
d as (select repo_owner, repo_name, commit_hash, filename, description
      from changes_long where description is not null)
select u.repo_owner, u.repo_name, u.number,
  coalesce(string_agg(d.description, chr(10) || '--' || chr(10) order by d.filename), '') as text
from und u left join d on u.repo_owner = d.repo_owner and u.repo_name = d.repo_name
  and u.merge_commit_sha = d.commit_hash
group by 1, 2, 3""")
def q_pr_text(spark, sf):
    return P.pr_text(X.pull_requests(spark, sf), X.changes_long(spark, sf))


@query("undescribed_pulls", PR + """select distinct repo_owner, repo_name, merge_commit_sha, number
from pulls where description is null""")
def q_undescribed_pulls(spark, sf):
    return P.undescribed_pulls(X.pull_requests(spark, sf))


@query("merge_hours", PR + """select repo_owner, repo_name,
  cast(avg(date_diff('second', created_at, merged_at)) / 3600 as decimal(18,4)) as avg_merge_time_hours
from pulls where merged group by 1, 2""")
def q_merge_hours(spark, sf):
    return P.merge_hours(X.pull_requests(spark, sf))


_PCOLS = "repo_owner, repo_name, number, title, user_login, state, created_at, merged_at, closed_at"
_PC = [c.strip() for c in _PCOLS.split(",")]


@query("open_pulls", PR + f"select {_PCOLS} from pulls where state = 'open'")
def q_open_pulls(spark, sf):
    return P.open_pulls(X.pull_requests(spark, sf)).select(*_PC)


@query("merged_last_month", PR + f"""select {_PCOLS} from pulls
where merged and merged_at >= cast(date '{LONG_AS_OF}' - interval 1 month as timestamp)""")
def q_merged_last_month(spark, sf):
    return P.merged_since(X.pull_requests(spark, sf), LONG_AS_OF).select(*_PC)


@query("pulls_by_user", PR + f"""select {_PCOLS} from pulls
where user_login = (select min(c_name) from customer)""")
def q_pulls_by_user(spark, sf):
    prs = X.pull_requests(spark, sf)
    first = X.read_table(spark, sf, "customer").agg(F.min("c_name").alias("_u"))
    # the user is data-derived (a one-row aggregate joined on equality)
    return prs.join(first, prs.user_login == first._u).select(*_PC)


@query("pulls_title", PR + f"select {_PCOLS} from pulls where title like '%URGENT%'")
def q_pulls_title(spark, sf):
    return P.pulls_titled(X.pull_requests(spark, sf), "URGENT").select(*_PC)


_CCOLS = ["repo_owner", "repo_name", "commit_hash", "filename", "committed_at", "author",
          "churn_count", "description"]


@query("insert_new", LONG + """select repo_owner, repo_name, commit_hash, filename, committed_at,
  author, churn_count, description from changes_long where committed_at >= timestamp '1998-01-01'""")
def q_insert_new(spark, sf):
    # Target holds the history before 1998; the batch re-sends the last
    # half year of it plus everything newer, twice (second copy altered):
    # only new keys are inserted and the first copy wins.
    # the changes table is written once, as a stored table would be
    from ..session import scratch_path
    import uuid
    path = scratch_path(spark, f"changes-{uuid.uuid4().hex}")
    X.changes_long(spark, sf).select(*_CCOLS).write.parquet(path)
    ch = spark.read.parquet(path)
    target = ch.filter(F.col("committed_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    batch = (ch.filter(F.col("committed_at") >= F.lit("1997-07-01").cast("timestamp_ntz"))
             .withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
             .withColumn("description", F.when(F.col("_copy") == 2, F.lit("duplicate"))
                         .otherwise(F.col("description"))))
    new = U.insert_new(target, batch, [*REPO, "commit_hash", "filename"], ["_copy"])
    return new.select(*_CCOLS)


@query("backfill", LONG + """select repo_owner, repo_name, commit_hash, filename,
  coalesce(description, 'new ' || filename) as description from changes_long""")
def q_backfill(spark, sf):
    # A description log with three entries for each undescribed change
    # (older, newer, and a same-time later line that must lose) and one for
    # each described change (must not override).
    ch = X.changes_long(spark, sf)
    t = F.col("committed_at")
    e = F.when(F.col("description").isNull(), F.array(
        F.struct((t + F.expr("interval 1 day")).alias("logged_at"), F.lit(1).cast("bigint").alias("position"),
                 F.concat(F.lit("old "), F.col("filename")).alias("text")),
        F.struct((t + F.expr("interval 2 days")).alias("logged_at"), F.lit(2).cast("bigint").alias("position"),
                 F.concat(F.lit("new "), F.col("filename")).alias("text")),
        F.struct((t + F.expr("interval 2 days")).alias("logged_at"), F.lit(3).cast("bigint").alias("position"),
                 F.concat(F.lit("late "), F.col("filename")).alias("text")),
    )).otherwise(F.array(
        F.struct(t.alias("logged_at"), F.lit(1).cast("bigint").alias("position"),
                 F.lit("ignored").alias("text"))))
    log = ch.select(*REPO, "filename", "commit_hash", F.inline(e))
    out = U.backfill_descriptions(ch, log)
    return out.select(*REPO, "commit_hash", "filename", "description")


@query("update_by_key", LONG + """select repo_owner, repo_name, commit_hash, filename,
  case when churn_count > 100 then 'large change' else description end as description
from changes_long""")
def q_update_by_key(spark, sf):
    # Set the description of large changes by key
    ch = X.changes_long(spark, sf)
    upd = (ch.filter(F.col("churn_count") > 100)
           .select(*REPO, "commit_hash", "filename", F.lit("large change").alias("description")))
    out = U.update_by_key(ch, upd, [*REPO, "commit_hash", "filename"], ["description"])
    return out.select(*REPO, "commit_hash", "filename", "description")


@query("undescribed_changes", LONG + """select repo_owner, repo_name, commit_hash, filename
from changes_long where description is null""")
def q_undescribed_changes(spark, sf):
    # Changes still to describe = all minus those with a description
    ch = X.changes_long(spark, sf)
    done = ch.filter(F.col("description").isNotNull())
    return U.todo(ch.select(*REPO, "commit_hash", "filename"), done,
                  [*REPO, "commit_hash", "filename"])


@query("large_changes", LONG + """select repo_owner, repo_name, commit_hash, filename, churn_count
from changes_long where churn_count > 40""")
def q_large_changes(spark, sf):
    # K5: changes with churn above a threshold
    return (X.changes_long(spark, sf).filter(F.col("churn_count") > 40)
            .select(*REPO, "commit_hash", "filename", "churn_count"))


@query("recent_files", LONG + f"""select repo_owner, repo_name, filename from changes_long
where committed_at > cast(date '{K4_AS_OF}' - interval 30 day as timestamp)""")
def q_recent_files(spark, sf):
    # K4: files changed in the 30 days before as_of (one row per change)
    lo = F.date_sub(F.to_date(F.lit(K4_AS_OF)), 30).cast("timestamp_ntz")
    return (X.changes_long(spark, sf).filter(F.col("committed_at") > lo)
            .select(*REPO, "filename"))
