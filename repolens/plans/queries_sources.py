"""Registered source/sink queries: the driver's tables are written in each
file format under the checkpoint folder and read back by the readers
(S1-S7, S11, S14, U9), so the oracle is the original view."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from .. import REPO
from ..schemas import REJECTS
from ..session import cut_lineage, scratch_path
from ..sources import commit_log as S1
from ..sources import description_log as S4
from ..sources import fixtures as X
from ..sources import logs as L
from ..sources import pull_requests as S3
from ..streaming.ingest import ingest_stream, read_target
from .registry import query

LONG = X.sql_with(X.SQL_CHANGES_LONG)
PR = X.sql_with(X.SQL_PULL_REQUESTS)

# authors excluded in the commit-log round trip (case-insensitive search)
EXCLUDE_AUTHORS = "customer#00000000"


def _tmp(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


@query("commit_log_roundtrip", LONG + f"""select repo_owner, repo_name, commit_hash, committed_at,
  author, filename, churn_count from changes_long
where not regexp_matches(author, '{EXCLUDE_AUTHORS}', 'i')""")
def q_commit_log_roundtrip(spark, sf):
    ch = X.changes_long(spark, sf)
    path = _tmp(spark, "gitlog")
    S1.write_commit_log(ch, path)
    changes, _ = S1.read_commit_log(spark, path, exclude_authors=EXCLUDE_AUTHORS)
    return changes.select(*REPO, "commit_hash", "committed_at", "author", "filename", "churn_count")


@query("pr_dump_roundtrip", PR + """select repo_owner, repo_name, number, title, user_login, state,
  created_at, merged, merged_at, closed_at, merge_commit_sha, description from pulls""")
def q_pr_dump_roundtrip(spark, sf):
    prs = X.pull_requests(spark, sf)
    path = _tmp(spark, "prs")
    S3.write_pull_requests(prs, path)
    back = S3.read_pull_requests(spark, path)
    return back.select(*REPO, "number", "title", "user_login", "state", "created_at", "merged",
                       "merged_at", "closed_at", "merge_commit_sha", "description")


_DOC_LOG = """select 'docs' as repo_owner, source as repo_name,
  timestamp '2024-01-01 00:00:00' + to_seconds(doc_id) as logged_at,
  concat('doc/', cast(doc_id as varchar)) as filename, md5(cast(doc_id as varchar)) as commit_hash,
  text from documents"""


def _doc_log(spark, sf):
    d = X.read_table(spark, sf, "documents")
    return d.select(F.lit("docs").alias("repo_owner"), F.col("source").alias("repo_name"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)")))
                    .alias("logged_at"),
                    F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("filename"),
                    F.md5(F.col("doc_id").cast("string")).alias("commit_hash"), "text")


@query("description_log_roundtrip", "with x as (" + _DOC_LOG + """)
select repo_owner, repo_name, logged_at, filename, commit_hash, text from x""")
def q_description_log_roundtrip(spark, sf):
    # whole multi-line document texts as log records, read back by S4
    path = _tmp(spark, "desclog")
    S4.append_descriptions(_doc_log(spark, sf), path)
    back = S4.read_description_log(spark, path)
    return back.select(*REPO, "logged_at", "filename", "commit_hash", "text")


@query("stream_ingest", LONG + """select repo_owner, repo_name, commit_hash, committed_at, author,
  filename, churn_count from changes_long""")
def q_stream_ingest(spark, sf):
    # Logs land in two waves (orders before 1998, then all of them
    # again); each wave is one availableNow run; the second inserts only
    # what is new.
    log = cut_lineage(S1.render_commit_log(X.changes_long(spark, sf, with_order=True), by=("_order",), keep=("committed_at",)))
    src, target, ckpt = _tmp(spark, "inbox"), _tmp(spark, "changes"), _tmp(spark, "stream-ckpt")
    S1.write_rendered(log.filter(F.col("committed_at") < F.lit("1998-01-01").cast("timestamp_ntz")), src)
    ingest_stream(spark, src, target, ckpt)
    S1.write_rendered(log, src, mode="append")
    ingest_stream(spark, src, target, ckpt)
    return (read_target(spark, target)
            .select(*REPO, "commit_hash", "committed_at", "author", "filename", "churn_count"))


@query("stream_rejects", LONG + """, c as (select *, substr(commit_hash, 1, 1) as h from changes_long)
select repo_owner, repo_name, 'record' as kind, count(distinct commit_hash) as n, 0 as named from c where h in ('a', 'b') group by 1, 2
union all select repo_owner, repo_name, 'line', count(*), count(*) from c where h = 'c' group by 1, 2
union all select repo_owner, repo_name, 'inserted', count(*), count(*) from c where h not in ('a', 'b', 'c') group by 1, 2""")
def q_stream_rejects(spark, sf):
    # Logs with records of too few header fields (hash a...), bad
    # times (b...) and file lines of too few fields (c...); the rejects are
    # stored by the intake
    log = S1.render_commit_log(X.changes_long(spark, sf, with_order=True), by=("_order",))
    first = F.substring("value", 3, 1)
    broken = (F.when(first == "a", F.regexp_replace("value", "--", "-"))
              .when(first == "b", F.regexp_replace("value", r"--(\d{4})-", "--$1/"))
              .when(first == "c", F.regexp_replace("value", r"\t(\d+)\t", " $1\t")).otherwise(F.col("value")))
    src, target, ckpt = _tmp(spark, "inbox"), _tmp(spark, "changes"), _tmp(spark, "stream-ckpt")
    log.select(*REPO, broken.alias("value")).write.partitionBy(*REPO).text(src)
    ingest_stream(spark, src, target, ckpt)
    named = lambda kind, rows: rows.groupBy(*REPO, kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count("commit_hash").cast("bigint").alias("named"))
    rejects = spark.read.schema(REJECTS).parquet(target + "-rejects")
    return named(F.col("kind"), rejects).unionByName(named(F.lit("inserted"), read_target(spark, target)))


# USD per 1M tokens of the default model (input, output).
DEFAULT_SERVICE, DEFAULT_MODEL = "openai", "gpt-4o-mini"
PRICES = {DEFAULT_SERVICE: {DEFAULT_MODEL: {"input": 0.150, "output": 0.600}}}


def write_price_list(spark, path: str) -> None:
    spark.createDataFrame([(json.dumps(PRICES),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


@query("conversation_costs", """with calls as (
  select role, cast(ceil(length(text) / 4.0) as bigint) as tokens from conversations)
select role, count(*) as messages,
  cast(sum(case when role = 'assistant' then 0 else tokens end) as bigint) as input_tokens,
  cast(sum(case when role = 'assistant' then tokens else 0 end) as bigint) as output_tokens,
  cast(sum(case when role = 'assistant' then 0 else tokens end) * 0.000000150
     + sum(case when role = 'assistant' then tokens else 0 end) * 0.000000600 as decimal(18,9)) as cost
from calls group by 1""")
def q_conversation_costs(spark, sf):
    # Token estimate per message (length / 4, rounded up), the
    # assistant's turns are output tokens, the rest input; priced from the
    # price list file (read by S7) for the default model.
    path = _tmp(spark, "pricing")
    write_price_list(spark, path)
    from ..operators.annotate import estimate_tokens, price_calls
    msgs = X.read_table(spark, sf, "conversations")
    calls = msgs.select("role", estimate_tokens("text").alias("tokens")).select(
        "role",
        F.when(F.col("role") == "assistant", 0).otherwise(F.col("tokens")).alias("input_tokens"),
        F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(0).alias("output_tokens"),
        F.lit(DEFAULT_SERVICE).alias("service"), F.lit(DEFAULT_MODEL).alias("model"))
    priced = price_calls(calls, L.read_pricing(spark, path))
    return (priced.groupBy("role")
            .agg(F.count(F.lit(1)).alias("messages"),
                 F.sum("input_tokens").cast("bigint").alias("input_tokens"),
                 F.sum("output_tokens").cast("bigint").alias("output_tokens"),
                 F.sum("cost").cast("decimal(18,9)").alias("cost")))
