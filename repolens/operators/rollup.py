"""Summaries kept up to date batch by batch.

A summary's state is a table of partial aggregates that add up: the state of
all rows is the merge of the states of any batches that make them up, in any
order.  Stored states are versions below one path; a batch reads the last
whole version, adds its own partial state and writes the next one, so neither
the rows of earlier batches are read again nor is anything lost when a run
ends half-way.

Rows must be unique by (repo, commit_hash, filename), which is what ``insert_new``
lets through: then a commit's file rows, and a file's commits, are counted by
adding rows, also when a commit comes in several batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import REPO
from ..functions.time import days_ago
from ..session import child_names
from .tags import dec_sum, with_tag_names

TIME = "committed_at"


@dataclass(frozen=True)
class Summary:
    """``keys`` and ``parts`` (column -> first aggregate, merge aggregate) of
    a state, and what a reader gets from it."""
    keys: Callable[[], list[Column]]
    parts: dict[str, tuple[Callable[[], Column], Callable[[str], Column]]]
    final: Callable[..., DataFrame]

    def names(self, state: DataFrame) -> list[str]:
        return [c for c in state.columns if c not in self.parts]


def _count() -> Column:
    return F.count(F.lit(1))


def _by_date(state: DataFrame, as_of: str) -> DataFrame:
    """A commit's files count on each of its days, as in ``commits_by_date``."""
    per_commit = state.groupBy(*REPO, "commit_hash").agg(F.sum("files").alias("files"), F.collect_set("day").alias("days"))
    return (per_commit.select(*REPO, "files", F.explode("days").alias("date")).groupBy(*REPO, "date")
            .agg(_count().alias("commit_count"), F.sum("files").cast("bigint").alias("file_count"))
            .withColumn("days_ago", days_ago("date", as_of)))


def _tag_totals(state: DataFrame, tags: DataFrame) -> DataFrame:
    named = with_tag_names(state, tags)
    return named.groupBy(*REPO, "name").agg(F.round(F.sum("total"), 2).cast("decimal(18,2)").alias("total_value"))


SUMMARIES = {
    "author_tenure": Summary(
        lambda: [F.col(c) for c in (*REPO, "author")],
        {"total_file_commits": (_count, F.sum), "first_commit_date": (lambda: F.min(TIME), F.min), "last_commit_date": (lambda: F.max(TIME), F.max)},
        lambda state: state),
    "file_commit_counts": Summary(lambda: [F.col(c) for c in (*REPO, "filename")], {"commit_count": (_count, F.sum)}, lambda state: state),
    "commits_by_date": Summary(lambda: [*(F.col(c) for c in (*REPO, "commit_hash")), F.to_date(TIME).alias("day")], {"files": (_count, F.sum)}, _by_date),
    "tag_totals": Summary(lambda: [F.col(c) for c in (*REPO, "tag_id")],
                          {"total": (lambda: dec_sum("value"), F.sum)}, _tag_totals),
}


def partial(name: str, rows: DataFrame) -> DataFrame:
    """The state of a batch of rows (changes; for tag totals, tag rows)."""
    s = SUMMARIES[name]
    return rows.groupBy(*s.keys()).agg(*[first().alias(c) for c, (first, _) in s.parts.items()])


def merge(name: str, *states: DataFrame) -> DataFrame:
    """One state from the states of disjoint batches."""
    s, all_ = SUMMARIES[name], states[0]
    for x in states[1:]:
        all_ = all_.unionByName(x)
    kinds = dict(states[0].dtypes)
    return all_.groupBy(*s.names(states[0])).agg(*[m(c).cast(kinds[c]).alias(c) for c, (_, m) in s.parts.items()])


def final(name: str, state: DataFrame, *args, **kwargs) -> DataFrame:
    """The summary as its operator gives it for all rows at once."""
    return SUMMARIES[name].final(state, *args, **kwargs)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions: those with the mark that a finished write leaves."""
    found = [int(n.removeprefix("v=")) for n in child_names(spark, path) if n.startswith("v=")]
    return sorted(v for v in found if "_SUCCESS" in child_names(spark, f"{path}/v={v}"))


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole version, None before the first batch."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={versions[-1]}") if versions else None


def add_batch(name: str, rows: DataFrame, path: str, batch: int) -> DataFrame:
    """Merge batch number ``batch`` (from 1, in order) into the stored state;
    a batch that is there already adds nothing, so a run can be repeated."""
    spark = rows.sparkSession
    versions = _versions(spark, path)
    done = versions[-1] if versions else 0
    if batch > done + 1:
        raise ValueError(f"batch {batch} after batch {done}")
    if batch == done + 1:
        states = [partial(name, rows)] + ([spark.read.parquet(f"{path}/v={done}")] if done else [])
        merge(name, *states).write.mode("overwrite").parquet(f"{path}/v={batch}")
    return read_state(spark, path)
