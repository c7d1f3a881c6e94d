"""Commit activity: by author, by file, by day/week, date span.

Counts of commits and files are true distinct counts, so they hold for any
table of changes, also one with a key twice; Spark aggregates them partially
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import REPO
from ..functions.time import DAY_WEEK_SWITCH_DAYS, days_ago, since, since_literal
from ..plans.helpers import top_n

TIME = "committed_at"


def author_commits(changes: DataFrame, since_mdy: str | None = None, n: int = 50) -> DataFrame:
    """Distinct commits per author, top ``n`` per repository (A1, O1).
    Ties are broken by author name."""
    agg = (since(changes, since_mdy, TIME)
           .groupBy(*REPO, "author")
           .agg(F.countDistinct("commit_hash").alias("commits")))
    return top_n(agg, list(REPO), [F.desc("commits"), F.asc("author")], n)


def author_tenure(changes: DataFrame) -> DataFrame:
    """Per author: file rows (not commits), first and last commit time (A2)."""
    return (changes.groupBy(*REPO, "author")
            .agg(F.count(F.lit(1)).alias("total_file_commits"),
                 F.min(TIME).alias("first_commit_date"),
                 F.max(TIME).alias("last_commit_date")))


def file_commits(changes: DataFrame, since_mdy: str | None = None, n: int = 50) -> DataFrame:
    """Distinct commits per file over described rows only, top ``n`` (A3)."""
    agg = (since(changes, since_mdy, TIME)
           .filter(F.col("description").isNotNull())
           .groupBy(*REPO, "filename")
           .agg(F.countDistinct("commit_hash").alias("commits")))
    return top_n(agg, list(REPO), [F.desc("commits"), F.asc("filename")], n)


def file_commit_counts(changes: DataFrame) -> DataFrame:
    """Distinct commits per file over all rows, no limit (A4)."""
    return (changes.groupBy(*REPO, "filename")
            .agg(F.countDistinct("commit_hash").alias("commit_count")))


def date_span(changes: DataFrame) -> DataFrame:
    """First and last commit time per repository."""
    return (changes.groupBy(*REPO)
            .agg(F.min(TIME).alias("first_date"), F.max(TIME).alias("last_date")))


def first_commit_mdy(changes: DataFrame) -> DataFrame:
    """Page default for ``since``: first commit day as ``MM/dd/yyyy``."""
    return date_span(changes).select(
        *REPO, F.date_format("first_date", "MM/dd/yyyy").alias("first_commit"))


def daily_activity(changes: DataFrame) -> DataFrame:
    """Per repository and day: distinct commits and distinct files.

    One scan; the two distinct counts share one aggregate (Spark expands
    each row once per distinct column and aggregates partially map-side).
    """
    return (changes.groupBy(*REPO, F.to_date(TIME).alias("day"))
            .agg(F.countDistinct("commit_hash").alias("commits"),
                 F.countDistinct("filename").alias("files")))


def commits_over_time(changes: DataFrame, since_mdy: str | None = None) -> DataFrame:
    """Commit and file counts per day, zero-filled from the start (``since``
    or the first day) to the last day with data; spans over 90 days switch to
    Monday weeks that hold the sum of the daily values (A5, T3, T4, J6).

    Output: repo, type ('Day'|'Week'), date, commits, files.

    One pass: the per-repository bounds are a window over the daily table
    (one row per day, so bounded by the time span); the repository's first
    day also emits the zero entries of the whole spine, and one aggregation
    sums entries per bucket.
    """
    daily = daily_activity(since(changes, since_mdy, TIME))
    w = Window.partitionBy(*REPO)
    start = F.to_date(since_literal(since_mdy)) if since_mdy else F.col("lo")
    d = (daily.withColumn("lo", F.min("day").over(w)).withColumn("hi", F.max("day").over(w))
         .withColumn("start", start)
         .withColumn("type", F.when(F.datediff("hi", "start") > DAY_WEEK_SWITCH_DAYS,
                                    F.lit("Week")).otherwise(F.lit("Day"))))
    week = F.col("type") == "Week"
    step_start = F.when(week, F.to_date(F.date_trunc("week", "start"))).otherwise(F.col("start"))
    step = F.when(week, F.expr("interval 7 days")).otherwise(F.expr("interval 1 day"))
    zero = F.lit(0).cast("bigint")
    own = F.array(F.struct(
        F.when(week, F.to_date(F.date_trunc("week", "day"))).otherwise(F.col("day")).alias("date"),
        F.col("commits").cast("bigint").alias("commits"), F.col("files").cast("bigint").alias("files")))
    spine = F.transform(F.sequence(step_start, F.col("hi"), step),
                        lambda x: F.struct(x.alias("date"), zero.alias("commits"), zero.alias("files")))
    entries = F.when(F.col("day") == F.col("lo"), F.concat(spine, own)).otherwise(own)
    return (d.select(*REPO, "type", F.inline(entries))
            .groupBy(*REPO, "type", "date")
            .agg(F.sum("commits").cast("bigint").alias("commits"),
                 F.sum("files").cast("bigint").alias("files")))


def commits_by_date(changes: DataFrame, as_of: str) -> DataFrame:
    """Per day: distinct commits, the sum over those commits of each
    commit's distinct file count, and days before ``as_of`` (A6, J8, P20).

    One scan: per commit, its distinct files and the set of its days (one day
    for a real commit), then exploded back to days.
    """
    per_commit = (changes.groupBy(*REPO, "commit_hash")
                  .agg(F.countDistinct("filename").alias("n_files"),
                       F.collect_set(F.to_date(TIME)).alias("days")))
    return (per_commit.select(*REPO, "n_files", F.explode("days").alias("date"))
            .groupBy(*REPO, "date")
            .agg(F.count(F.lit(1)).alias("commit_count"),
                 F.sum("n_files").cast("bigint").alias("file_count"))
            .withColumn("days_ago", days_ago("date", as_of)))


def changes_of(changes: DataFrame, author: str | None = None,
               filename: str | None = None) -> DataFrame:
    """Drill-down rows of one author and/or file."""
    out = changes
    if author is not None:
        out = out.filter(F.col("author") == author)
    if filename is not None:
        out = out.filter(F.col("filename") == filename)
    return out
