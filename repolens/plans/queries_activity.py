"""Registered activity and churn queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import churn as C
from ..sources import fixtures as X
from ..functions.text import COLORS
from .params import (LONG_SINCE, LONG_SINCE_TS, SHORT_AS_OF, SHORT_SINCE,
                     SHORT_SINCE_TS, TOP_N)
from .registry import query

LONG = X.sql_with(X.SQL_CHANGES_LONG)
SHORT = X.sql_with(X.SQL_CHANGES_SHORT)


def _top(view, key, agg, alias, where="", n=TOP_N):
    return f"""select repo_owner, repo_name, {key}, {alias} from (
  select repo_owner, repo_name, {key}, {agg} as {alias},
    row_number() over (partition by repo_owner, repo_name order by {agg} desc, {key}) as rn
  from {view} {where} group by 1, 2, 3) t where rn <= {n}"""


@query("author_commits", LONG + _top("changes_long", "author",
                                      "count(distinct commit_hash)", "commits"))
def q_author_commits(spark, sf):
    return A.author_commits(X.changes_long(spark, sf))


@query("author_commits_since", LONG + _top(
    "changes_long", "author", "count(distinct commit_hash)", "commits",
    where=f"where committed_at >= timestamp '{LONG_SINCE_TS}'"))
def q_author_commits_since(spark, sf):
    return A.author_commits(X.changes_long(spark, sf), since_mdy=LONG_SINCE)


@query("author_tenure", LONG + """select repo_owner, repo_name, author,
  count(*) as total_file_commits, min(committed_at) as first_commit_date,
  max(committed_at) as last_commit_date from changes_long group by 1, 2, 3""")
def q_author_tenure(spark, sf):
    return A.author_tenure(X.changes_long(spark, sf))


@query("file_commits", LONG + _top(
    "changes_long", "filename", "count(distinct commit_hash)", "commits",
    where="where description is not null"))
def q_file_commits(spark, sf):
    return A.file_commits(X.changes_long(spark, sf))


@query("file_commits_since", LONG + _top(
    "changes_long", "filename", "count(distinct commit_hash)", "commits",
    where=f"where description is not null and committed_at >= timestamp '{LONG_SINCE_TS}'"))
def q_file_commits_since(spark, sf):
    return A.file_commits(X.changes_long(spark, sf), since_mdy=LONG_SINCE)


@query("file_commit_counts", LONG + """select repo_owner, repo_name, filename,
  count(distinct commit_hash) as commit_count from changes_long group by 1, 2, 3""")
def q_file_commit_counts(spark, sf):
    return A.file_commit_counts(X.changes_long(spark, sf))


@query("date_span", LONG + """select repo_owner, repo_name, min(committed_at) as first_date,
  max(committed_at) as last_date from changes_long group by 1, 2""")
def q_date_span(spark, sf):
    return A.date_span(X.changes_long(spark, sf))


@query("first_commit_date", LONG + """select repo_owner, repo_name,
  strftime(min(committed_at), '%m/%d/%Y') as first_commit from changes_long group by 1, 2""")
def q_first_commit_date(spark, sf):
    return A.first_commit_mdy(X.changes_long(spark, sf))


def _over_time_sql(view: str, since_ts: str | None) -> str:
    where = f"where committed_at >= timestamp '{since_ts}'" if since_ts else ""
    start = f"cast(timestamp '{since_ts}' as date)" if since_ts else "min(day)"
    return f"""daily as (
  select repo_owner, repo_name, cast(committed_at as date) as day,
    count(distinct commit_hash) as commits, count(distinct filename) as files
  from {view} {where} group by 1, 2, 3),
bounds as (
  select repo_owner, repo_name, max(day) as hi, {start} as start,
    case when datediff('day', {start}, max(day)) > 90 then 'Week' else 'Day' end as type
  from daily group by 1, 2),
spine as (
  select repo_owner, repo_name, type, cast(unnest(generate_series(
      cast(case when type = 'Week' then date_trunc('week', start) else start end as timestamp),
      cast(hi as timestamp),
      case when type = 'Week' then interval 7 day else interval 1 day end)) as date) as date
  from bounds),
bucket as (
  select d.repo_owner, d.repo_name,
    case when b.type = 'Week' then cast(date_trunc('week', d.day) as date) else d.day end as date,
    sum(d.commits) as commits, sum(d.files) as files
  from daily d join bounds b on d.repo_owner = b.repo_owner and d.repo_name = b.repo_name
  group by 1, 2, 3)
select s.repo_owner, s.repo_name, s.type, s.date,
  cast(coalesce(k.commits, 0) as bigint) as commits, cast(coalesce(k.files, 0) as bigint) as files
from spine s left join bucket k
  on s.repo_owner = k.repo_owner and s.repo_name = k.repo_name and s.date = k.date"""


@query("commits_over_time_week", LONG + "," + _over_time_sql("changes_long", None))
def q_commits_over_time_week(spark, sf):
    return A.commits_over_time(X.changes_long(spark, sf))


@query("commits_over_time_week_since", LONG + "," + _over_time_sql("changes_long", LONG_SINCE_TS))
def q_commits_over_time_week_since(spark, sf):
    return A.commits_over_time(X.changes_long(spark, sf), since_mdy=LONG_SINCE)


@query("commits_over_time_day", SHORT + "," + _over_time_sql("changes_short", None))
def q_commits_over_time_day(spark, sf):
    return A.commits_over_time(X.changes_short(spark, sf))


@query("commits_over_time_day_since", SHORT + "," + _over_time_sql("changes_short", SHORT_SINCE_TS))
def q_commits_over_time_day_since(spark, sf):
    return A.commits_over_time(X.changes_short(spark, sf), since_mdy=SHORT_SINCE)


def _by_date_sql(view: str, as_of: str) -> str:
    return f"""per_commit as (
  select repo_owner, repo_name, commit_hash, count(distinct filename) as n_files
  from {view} group by 1, 2, 3),
commit_days as (
  select distinct repo_owner, repo_name, cast(committed_at as date) as date, commit_hash from {view})
select d.repo_owner, d.repo_name, d.date, count(*) as commit_count,
  cast(sum(p.n_files) as bigint) as file_count,
  cast(datediff('day', d.date, date '{as_of}') as integer) as days_ago
from commit_days d join per_commit p
  on d.repo_owner = p.repo_owner and d.repo_name = p.repo_name and d.commit_hash = p.commit_hash
group by 1, 2, 3"""


@query("commits_by_date", SHORT + "," + _by_date_sql("changes_short", SHORT_AS_OF))
def q_commits_by_date(spark, sf):
    return A.commits_by_date(X.changes_short(spark, sf), as_of=SHORT_AS_OF)


@query("commits_by_date_long", LONG + "," + _by_date_sql("changes_long", "2001-09-01"))
def q_commits_by_date_long(spark, sf):
    return A.commits_by_date(X.changes_long(spark, sf), as_of="2001-09-01")


@query("changes_by_author", LONG + """select c.repo_owner, c.repo_name, c.commit_hash,
  c.committed_at, c.author, c.filename, c.churn_count, c.description
from changes_long c join (select min(c_name) as a from customer) m on c.author = m.a""")
def q_changes_by_author(spark, sf):
    # K3: the drill-down of one author, the first customer name of the table
    first = (X.read_table(spark, sf, "customer").agg(F.min("c_name").alias("a")))
    ch = X.changes_long(spark, sf)
    return (ch.join(first, ch.author == first.a)
            .select(*A.REPO, "commit_hash", "committed_at", "author", "filename",
                    "churn_count", "description"))


@query("file_churn", LONG + """select repo_owner, repo_name, filename,
  cast(sum(churn_count) as bigint) as total_churn from changes_long
  where description is not null group by 1, 2, 3""")
def q_file_churn(spark, sf):
    return C.file_churn(X.changes_long(spark, sf))


_COLORS_SQL = "[" + ", ".join(f"'{c}'" for c in COLORS) + "]"


@query("churn_tree", LONG + f""",
files as (
  select repo_owner, repo_name, filename, sum(churn_count) as total_churn
  from changes_long where description is not null group by 1, 2, 3),
nodes as (
  select repo_owner, repo_name, total_churn, parts, d from (
    select repo_owner, repo_name, total_churn, string_split(filename, '/') as parts,
      unnest(range(1, len(string_split(filename, '/')) + 1)) as d from files) t)
select repo_owner, repo_name, array_to_string(parts[1:d], '/') as path,
  case when d > 1 then array_to_string(parts[1:d - 1], '/') end as parent,
  parts[d] as name, cast(d as integer) as depth,
  {_COLORS_SQL}[((d - 1) % 7) + 1] as color, d = len(parts) as is_file,
  cast(sum(total_churn) as bigint) as churn
from nodes group by all
union all
select repo_owner, repo_name, '' as path, null as parent, 'repo' as name, 0 as depth,
  null as color, false as is_file, cast(sum(total_churn) as bigint) as churn
from files group by 1, 2""")
def q_churn_tree(spark, sf):
    return C.churn_tree(X.changes_long(spark, sf))


@query("directory_commits", LONG + """, per_file as (
  select repo_owner, repo_name, filename, count(distinct commit_hash) as commits
  from changes_long group by 1, 2, 3)
select repo_owner, repo_name,
  array_to_string(string_split(filename, '/')[1:len(string_split(filename, '/')) - 1], '/') as directory,
  cast(sum(commits) as bigint) as commits
from per_file group by 1, 2, 3""")
def q_directory_commits(spark, sf):
    return C.directory_commits(X.changes_long(spark, sf))


@query("directory_commits_top_level", LONG + """, per_file as (
  select repo_owner, repo_name, filename, count(distinct commit_hash) as commits
  from changes_long group by 1, 2, 3)
select repo_owner, repo_name,
  array_to_string(string_split(filename, '/')[1:least(1, len(string_split(filename, '/')) - 1)], '/') as directory,
  cast(sum(commits) as bigint) as commits
from per_file group by 1, 2, 3""")
def q_directory_commits_top_level(spark, sf):
    # A19 with the directory cut to its first level
    return C.directory_commits(X.changes_long(spark, sf), levels=1)
