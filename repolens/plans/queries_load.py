"""Registered queries of loading: what an insert skips (U1), updates without a
row (U3), the backfill from a written log and switched off (U5, U8, S4, S5),
and tags added to a dimension (S13)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import REPO
from ..operators import load as U
from ..operators import tags as G
from ..session import cut_lineage, scratch_path
from ..sources import description_log as S4
from ..sources import fixtures as X
from .registry import query

LONG = X.sql_with(X.SQL_CHANGES_LONG)
KEY = [*REPO, "commit_hash", "filename"]


def _tmp(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


@query("insert_report", LONG + """select repo_owner, repo_name, cast(count(*) + count(*) filter (churn_count % 3 = 0) as bigint) as read,
  count(*) filter (committed_at >= timestamp '1998-01-01') as inserted,
  cast(count(*) + count(*) filter (churn_count % 3 = 0) - count(*) filter (committed_at >= timestamp '1998-01-01') as bigint) as skipped
from changes_long group by 1, 2""")
def q_insert_report(spark, sf):
    # A batch with repeated keys, and with keys that are stored already
    ch = X.changes_long(spark, sf)
    # a repeated row lies beside the one it repeats
    authors = F.when(F.col("churn_count") % 3 == 0, F.array("author", F.lit("again"))).otherwise(F.array("author"))
    batch = ch.select(*[F.explode(authors).alias(c) if c == "author" else F.col(c) for c in ch.columns])
    target = ch.filter(F.col("committed_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return U.insert_counted(target, batch, KEY, ["author"], by_range=True)[1]


@query("update_not_found", LONG + """select repo_owner, repo_name, commit_hash, concat(filename, 'x') as filename from changes_long where churn_count % 4 = 1""")
def q_update_not_found(spark, sf):
    # Updates of changes that are there and of changes that are not
    ch = X.changes_long(spark, sf)
    name = F.when(F.col("churn_count") % 4 == 1, F.concat("filename", F.lit("x"))).otherwise(F.col("filename"))
    updates = ch.filter("churn_count % 4 in (1, 2)").select(*REPO, "commit_hash", name.alias("filename"), F.lit("text").alias("description"))
    return U.not_found(ch, updates, KEY).select(*KEY)


@query("backfill_from_log", LONG + """select true as enabled, repo_owner, repo_name, commit_hash, filename,
  coalesce(description, 'new ' || filename || chr(10) || 'second line') as description from changes_long
union all select false, repo_owner, repo_name, commit_hash, filename, description from changes_long""")
def q_backfill_from_log(spark, sf):
    # S5 -> S4 -> U5/U8: three appends to the log; the later time wins, at
    # equal times the earlier append, whatever the file times are
    # computed once: each append and each backfill reads it
    ch = cut_lineage(X.changes_long(spark, sf).select(*KEY, "committed_at", "description"))
    path = _tmp(spark, "desclog")
    undone = ch.filter("description is null")
    for days, text in ((1, F.concat(F.lit("old "), "filename")), (2, F.concat(F.lit("new "), "filename", F.lit("\nsecond line"))), (2, F.lit("late"))):
        S4.append_descriptions(undone.select(*REPO, (F.col("committed_at") + F.expr(f"interval {days} days")).alias("logged_at"),
                                             "filename", "commit_hash", text.alias("text")), path)
    log = S4.read_description_log(spark, path)
    out = None
    for enabled in (True, False):
        part = U.backfill_descriptions(ch, log, enabled=enabled).select(F.lit(enabled).alias("enabled"), *KEY, "description")
        out = part if out is None else out.unionByName(part)
    return out


@query("tags_dim_insert", LONG + """, r as (select repo_owner, repo_name, count(*) as n from changes_long group by 1, 2),
b as (select distinct repo_owner, repo_name, cast(regexp_extract(filename, 'brand_(\\d+)', 1) as int) as id from changes_long),
kept as (select repo_owner, repo_name, cast(id * 2 as int) as tag_id, concat('brand', id) as name from b where id <= 12),
fresh as (select repo_owner, repo_name, pos, name from r, (values (1, 'Docs'), (2, 'brand14'), (3, 'Tests')) as t(pos, name))
select repo_owner, repo_name, tag_id, name from kept
union all select f.repo_owner, f.repo_name, cast((select max(tag_id) from kept k where k.repo_owner = f.repo_owner and k.repo_name = f.repo_name) + pos as int), name
from fresh f""")
def q_tags_dim_insert(spark, sf):
    # Names that the dimension holds are ignored, new ones get the ids
    # after its largest
    ch = X.changes_long(spark, sf)
    number = F.regexp_extract("filename", r"brand_(\d+)", 1).cast("int")
    held = (ch.select(*REPO, number.alias("id")).distinct().filter("id <= 12")
            .select(*REPO, (F.col("id") * 2).cast("int").alias("tag_id"), F.concat(F.lit("brand"), F.col("id").cast("string")).alias("name")))
    return G.tags_dim("brand1, Docs, brand14, brand2, Docs,, Tests", ch, existing=held)
