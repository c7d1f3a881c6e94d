"""Registered tag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import REPO
from ..operators import tags as G
from ..sources import fixtures as X
from .params import SHORT_AS_OF, SHORT_SINCE, SHORT_SINCE_TS
from .registry import query

CT = X.sql_with(X.SQL_COMMIT_TAGS)
KEY = ["id"]


def _ct(spark, sf):
    return X.event_commit_tags(spark, sf), X.event_tags(spark, sf), X.changes_short(spark, sf)


@query("tag_totals", CT + """select c.repo_owner, c.repo_name, t.name,
  cast(round(sum(cast(c.value as decimal(18,9))), 2) as decimal(18,2)) as total_value
from ctags c join tags_dim t on c.repo_owner = t.repo_owner and c.repo_name = t.repo_name and c.tag_id = t.tag_id group by 1, 2, 3""")
def q_tag_totals(spark, sf):
    ct, tags, _ = _ct(spark, sf)
    return G.tag_totals(ct, tags)


@query("tag_totals_since", CT + f"""select c.repo_owner, c.repo_name, t.name,
  cast(round(sum(cast(c.value as decimal(18,9))), 2) as decimal(18,2)) as total_value
from ctags c join tags_dim t on c.repo_owner = t.repo_owner and c.repo_name = t.repo_name and c.tag_id = t.tag_id join changes_short s on s.repo_owner = c.repo_owner and s.repo_name = c.repo_name and s.id = c.id
where s.committed_at >= timestamp '{SHORT_SINCE_TS}' group by 1, 2, 3""")
def q_tag_totals_since(spark, sf):
    ct, tags, ch = _ct(spark, sf)
    return G.tag_totals(ct, tags, ch, KEY, since_mdy=SHORT_SINCE)


@query("tag_totals_other", CT + """, tot as (
  select c.repo_owner, c.repo_name, t.name,
    cast(round(sum(cast(c.value as decimal(18,9))), 2) as decimal(18,2)) as total_value
  from ctags c join tags_dim t on c.repo_owner = t.repo_owner and c.repo_name = t.repo_name and c.tag_id = t.tag_id group by 1, 2, 3),
ranked as (
  select *, row_number() over (partition by repo_owner, repo_name order by total_value desc, name) as rn,
    count(*) over (partition by repo_owner, repo_name) as k from tot)
select repo_owner, repo_name, case when k <= 3 or rn <= 3 then name else 'Other' end as name,
  cast(sum(total_value) as decimal(18,2)) as total_value from ranked group by 1, 2, 3""")
def q_tag_totals_other(spark, sf):
    # 5 tags in the data, so the fold keeps 3 to exercise "Other"
    ct, tags, _ = _ct(spark, sf)
    return G.tag_totals(ct, tags, include_all=False, n=3)


_ROWS = """, tagged as (
  select c.repo_owner, c.repo_name, t.name, c.value, s.committed_at,
    cast(date_trunc('week', s.committed_at) as date) as week_starting
  from ctags c join tags_dim t on c.repo_owner = t.repo_owner and c.repo_name = t.repo_name and c.tag_id = t.tag_id join changes_short s on s.repo_owner = c.repo_owner and s.repo_name = c.repo_name and s.id = c.id)"""


@query("tags_by_week", CT + _ROWS + f""",
weekly as (
  select repo_owner, repo_name, week_starting, name,
    cast(round(sum(cast(value as decimal(18,9))), 2) as decimal(18,2)) as total
  from tagged group by 1, 2, 3, 4),
spine as (
  select repo_owner, repo_name, cast(unnest(generate_series(
    date_trunc('week', min(committed_at)), date_trunc('week', timestamp '{SHORT_AS_OF}'),
    interval 7 day)) as date) as week_starting
  from tagged group by 1, 2)
select s.repo_owner, s.repo_name,
  printf('%d-%02d', isoyear(s.week_starting), week(s.week_starting)) as week,
  s.week_starting, w.name as tag, w.total
from spine s left join weekly w on s.repo_owner = w.repo_owner and s.repo_name = w.repo_name
  and s.week_starting = w.week_starting""")
def q_tags_by_week(spark, sf):
    ct, tags, ch = _ct(spark, sf)
    return G.tags_by_week(ct, tags, ch, KEY, as_of=SHORT_AS_OF)


_SHARE = _ROWS + """,
weekly as (
  select repo_owner, repo_name, week_starting, name, sum(cast(value as decimal(18,9))) as s
  from tagged group by 1, 2, 3, 4),
share as (
  select repo_owner, repo_name, week_starting, name, s,
    sum(s) over (partition by repo_owner, repo_name, week_starting) as w from weekly),
pct as (
  select repo_owner, repo_name, printf('%d-%02d', isoyear(week_starting), week(week_starting)) as week,
    week_starting, name as tag, cast(round(s, 2) as decimal(18,2)) as raw,
    cast(round(cast(case when w = 0 then 0.0 else cast(s as double) * 100 / cast(w as double) end
      as decimal(18,6)), 2) as decimal(18,2)) as percentage
  from share)"""


@query("tag_share_by_week", CT + _SHARE + "\nselect * from pct")
def q_tag_share_by_week(spark, sf):
    ct, tags, ch = _ct(spark, sf)
    return G.tag_share_by_week(ct, tags, ch, KEY)


@query("tag_share_matrix", CT + _SHARE + f""",
spine as (
  select repo_owner, repo_name, cast(unnest(generate_series(
    date_trunc('week', min(committed_at)), date_trunc('week', timestamp '{SHORT_AS_OF}'),
    interval 7 day)) as date) as week_starting
  from tagged group by 1, 2),
grid as (
  select s.repo_owner, s.repo_name, s.week_starting, t.tag
  from spine s join (select distinct repo_owner, repo_name, tag from pct) t
    on s.repo_owner = t.repo_owner and s.repo_name = t.repo_name)
select g.repo_owner, g.repo_name, g.tag,
  cast(list(coalesce(p.percentage, cast(0 as decimal(18,2))) order by g.week_starting) as double[]) as weekly_percentage
from grid g left join pct p on g.repo_owner = p.repo_owner and g.repo_name = p.repo_name
  and g.week_starting = p.week_starting and g.tag = p.tag
group by 1, 2, 3""")
def q_tag_share_matrix(spark, sf):
    ct, tags, ch = _ct(spark, sf)
    m = G.tag_share_matrix(ct, tags, ch, KEY, as_of=SHORT_AS_OF)
    return m.withColumn("weekly_percentage", F.col("weekly_percentage").cast("array<double>"))


@query("parse_tags", X.sql_with(X.SQL_TAGS, X.SQL_TAG_RESPONSES) + """,
cells as (select repo_owner, repo_name, id, string_split(trim(response), ',') as c from responses),
pairs as (
  select repo_owner, repo_name, id, i, trim(c[i + 1]) as tag, try_cast(trim(c[i + 2]) as integer) as weight
  from (select *, unnest(range(0, len(c), 2)) as i from cells) x),
known as (
  select p.* from pairs p where weight is not null
    and exists (select 1 from tags_dim t where t.repo_owner = p.repo_owner
                and t.repo_name = p.repo_name and t.name = p.tag)),
last as (select repo_owner, repo_name, id, tag, arg_max(weight, i) as weight from known group by 1, 2, 3, 4),
tot as (select *, sum(weight) over (partition by repo_owner, repo_name, id) as t from last)
select repo_owner, repo_name, id, tag, weight, cast(weight as double) / cast(t as double) as value
from tot where t <> 0""")
def q_parse_tags(spark, sf):
    resp = X.event_tag_responses(spark, sf)
    parsed = G.parse_tags(resp, X.event_tags(spark, sf), KEY)
    return G.normalise(parsed, KEY).select(*REPO, "id", "tag", "weight", "value")


@query("tag_rows", CT + """select c.repo_owner, c.repo_name, c.id, c.tag_id, c.value
from ctags c join tags_dim t on c.repo_owner = t.repo_owner and c.repo_name = t.repo_name and c.tag_id = t.tag_id where t.name = 'click'""")
def q_tag_rows(spark, sf):
    # K1: rows of one tag
    ct, tags, _ = _ct(spark, sf)
    one = tags.filter(F.col("name") == "click").select(*REPO, "tag_id")
    return ct.join(one, [*REPO, "tag_id"]).select(*REPO, "id", "tag_id", "value")


@query("top_tag_commits", CT + """select repo_owner, repo_name, id, value from (
  select c.repo_owner, c.repo_name, c.id, c.value,
    row_number() over (partition by c.repo_owner, c.repo_name order by c.value desc, c.id) as rn
  from ctags c join tags_dim t on c.repo_owner = t.repo_owner and c.repo_name = t.repo_name and c.tag_id = t.tag_id where t.name = 'purchase') x where rn <= 10""")
def q_top_tag_commits(spark, sf):
    # K2: ten changes with the highest share of one tag (per repository)
    from ..plans.helpers import top_n
    ct, tags, _ = _ct(spark, sf)
    one = tags.filter(F.col("name") == "purchase").select(*REPO, "tag_id")
    rows = ct.join(one, [*REPO, "tag_id"]).select(*REPO, "id", "value")
    return top_n(rows, list(REPO), [F.desc("value"), F.asc("id")], 10)


@query("tag_names", X.sql_with(X.SQL_TAGS) + "select repo_owner, repo_name, tag_id, name from tags_dim")
def q_tag_names(spark, sf):
    # K6 (all names) and K7 (id by name) read this dimension
    return X.event_tags(spark, sf)


@query("untagged_changes", X.sql_with(X.SQL_CHANGES_LONG) + """select count(*) as n from changes_long
where description is not null and trim(description) <> ''""")
def q_untagged_changes(spark, sf):
    # Described code changes without tag rows (none are tagged yet)
    ch = X.changes_long(spark, sf)
    # the tag table before any tagging run: empty, with its schema
    empty = spark.createDataFrame(
        [], "repo_owner string, repo_name string, commit_hash string, filename string")
    return G.untagged(ch, empty, ["commit_hash", "filename"]).agg(F.count(F.lit(1)).alias("n"))


@query("tags_by_week_since", CT + _ROWS + f""",
weekly as (
  select repo_owner, repo_name, week_starting, name,
    cast(round(sum(cast(value as decimal(18,9))), 2) as decimal(18,2)) as total
  from tagged where committed_at >= timestamp '{SHORT_SINCE_TS}' group by 1, 2, 3, 4),
spine as (
  select repo_owner, repo_name, cast(unnest(generate_series(
    date_trunc('week', timestamp '{SHORT_SINCE_TS}'), date_trunc('week', timestamp '{SHORT_AS_OF}'),
    interval 7 day)) as date) as week_starting
  from tagged where committed_at >= timestamp '{SHORT_SINCE_TS}' group by 1, 2)
select s.repo_owner, s.repo_name,
  printf('%d-%02d', isoyear(s.week_starting), week(s.week_starting)) as week,
  s.week_starting, w.name as tag, w.total
from spine s left join weekly w on s.repo_owner = w.repo_owner and s.repo_name = w.repo_name
  and s.week_starting = w.week_starting""")
def q_tags_by_week_since(spark, sf):
    # A9 with a since date: the spine starts at the since date's week
    ct, tags, ch = _ct(spark, sf)
    return G.tags_by_week(ct, tags, ch, KEY, since_mdy=SHORT_SINCE, as_of=SHORT_AS_OF)
