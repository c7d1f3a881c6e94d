"""Pull requests: recent list, description text, lead time, catalogue
filters (J3, J4, O2, O6, A17, T7, K8-K12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import REPO
from ..functions.text import format_description
from ..functions.time import iso_week, since
from ..plans.helpers import top_n

# List length of the recent view; separator of change texts.
RECENT_PRS = 10
PR_TEXT_SEPARATOR = "\n--\n"


def _on_commit(prs: DataFrame, other: DataFrame):
    return [prs.repo_owner == other.repo_owner, prs.repo_name == other.repo_name,
            prs.merge_commit_sha == other.commit_hash]


def pull_changes(prs: DataFrame, changes: DataFrame) -> DataFrame:
    """PRs joined to the change rows of their merge commit."""
    c = changes.drop("description")
    return prs.join(c, _on_commit(prs, c)).drop(c.repo_owner).drop(c.repo_name)


def recent_pulls(prs: DataFrame, changes: DataFrame, since_mdy: str | None = None,
                 n: int = RECENT_PRS) -> DataFrame:
    """Latest merged PRs with the number of changed-file rows.

    Filter on closed_at, show merged_at's day; order by that day descending
    (NULL last), then number.  Change rows are counted per commit before the
    join, so the join sees one row per commit instead of one per file; with
    ``since`` only the commits of the PRs that are left are counted.
    """
    p = since(prs, since_mdy, "closed_at")
    if since_mdy:
        commits = p.select(*REPO, F.col("merge_commit_sha").alias("commit_hash"))
        changes = changes.join(commits, [*REPO, "commit_hash"], "left_semi")
    files = changes.groupBy(*REPO, "commit_hash").agg(F.count("filename").alias("_files"))
    j = p.join(files, _on_commit(p, files)).drop(files.repo_owner).drop(files.repo_name)
    g = (j.groupBy(*REPO, "number", "title", "html_url", "user_login", "description", "merged_at")
         .agg(F.sum("_files").alias("file_count"))
         .withColumn("date", F.to_date("merged_at")))
    top = top_n(g, list(REPO), [F.col("date").desc_nulls_last(), F.desc("number")], n)
    return top.select(
        *REPO, F.col("number").alias("pr_number"), "file_count",
        F.col("title").alias("pr_title"), F.col("html_url").alias("pr_url"), "date",
        iso_week("date").alias("week_str"), F.col("user_login").alias("user"),
        format_description("description").alias("description"))


def undescribed_pulls(prs: DataFrame) -> DataFrame:
    """Distinct (merge commit, number) of PRs without a description."""
    return (prs.filter(F.col("description").isNull())
            .select(*REPO, "merge_commit_sha", "number").distinct())


def pr_text(prs: DataFrame, changes: DataFrame) -> DataFrame:
    """For each undescribed PR, the non-null change descriptions of its merge
    commit joined by the separator, ordered by file (J4, A17); PRs without
    any keep an empty text.  The text is one value per PR, so its group is
    one commit's files."""
    und = undescribed_pulls(prs)
    d = (changes.filter(F.col("description").isNotNull())
         .select(*REPO, "commit_hash", "filename", "description"))
    j = und.join(d, _on_commit(und, d), "left").drop(d.repo_owner).drop(d.repo_name)
    sep = PR_TEXT_SEPARATOR.replace("\n", "\\n")
    return (j.groupBy(*REPO, "number")
            .agg(F.expr(f"listagg(description, '{sep}') within group (order by filename)")
                 .alias("_t"))
            .select(*REPO, "number", F.coalesce("_t", F.lit("")).alias("text")))


def merge_hours(prs: DataFrame) -> DataFrame:
    """Average hours from creation to merge over merged PRs."""
    secs = F.expr("timestampdiff(SECOND, created_at, merged_at)")
    return (prs.filter(F.col("merged"))
            .groupBy(*REPO)
            .agg((F.avg(secs) / 3600).cast("decimal(18,4)").alias("avg_merge_time_hours")))


def open_pulls(prs: DataFrame) -> DataFrame:
    """PRs in state open (K8)."""
    return prs.filter(F.col("state") == "open")


def merged_since(prs: DataFrame, as_of: str, months: int = 1) -> DataFrame:
    """PRs merged from ``months`` before ``as_of`` on (K9)."""
    lo = F.add_months(F.to_date(F.lit(as_of)), -months).cast("timestamp_ntz")
    return prs.filter(F.col("merged") & (F.col("merged_at") >= lo))


def pulls_by_user(prs: DataFrame, user: str) -> DataFrame:
    """PRs of one user."""
    return prs.filter(F.col("user_login") == user)


def pulls_titled(prs: DataFrame, word: str) -> DataFrame:
    """PRs whose title contains ``word`` (K12, LIKE '%word%')."""
    return prs.filter(F.col("title").contains(word))
