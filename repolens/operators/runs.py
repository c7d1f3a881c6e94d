"""Incremental runs steered by the run log (S11, U1, P7) and the rebuild of
single repositories (U7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import REPO
from ..schemas import CHANGES
from ..session import child_names
from ..sources.logs import append_runs, read_run_log
from .load import insert_new

KEYS = [*REPO, "commit_hash", "filename"]
# Repositories up to this number are named in the filter that the scan gets.
MOST_NAMED = 1000


def last_runs(spark: SparkSession, log_path: str) -> DataFrame:
    """repo, mark: the time of each repository's last completed run."""
    if not child_names(spark, log_path):
        return spark.createDataFrame([], "repo_owner string, repo_name string, mark timestamp_ntz")
    done = read_run_log(spark, log_path).filter("key = 'last_completed'")
    return done.groupBy(*REPO).agg(F.max(F.col("value").try_cast("timestamp_ntz")).alias("mark")).filter("mark is not null")


def since_last_run(changes: DataFrame, marks: DataFrame, late_days: int = 0) -> DataFrame:
    """The changes from the day of their repository's last run on, less
    ``late_days`` (P7: a run reads whole days); all changes of a repository
    that has not run yet.  Up to ``MOST_NAMED`` repositories, the days are
    literals that the scan filters by; more are joined."""
    day = F.date_sub(F.to_date("mark"), late_days).cast("timestamp_ntz")
    from_day = marks.select(*REPO, day.alias("_from"))
    known = from_day.limit(MOST_NAMED + 1).collect()
    if len(known) > MOST_NAMED:
        found = changes.join(from_day, list(REPO), "left")
        return found.filter(F.col("_from").isNull() | (F.col("committed_at") >= F.col("_from"))).select(*changes.columns)
    if not known:
        return changes
    any_of = lambda conditions: reduce(lambda a, b: a | b, conditions)
    is_repo = lambda r: (F.col("repo_owner") == r["repo_owner"]) & (F.col("repo_name") == r["repo_name"])
    ran = any_of(is_repo(r) for r in known)
    # The earliest day holds for all: one comparison that the scan pushes down.
    old = changes.filter(ran & (F.col("committed_at") >= F.lit(min(r["_from"] for r in known))))
    old = old.filter(any_of(is_repo(r) & (F.col("committed_at") >= F.lit(r["_from"])) for r in known))
    return old.unionByName(changes.filter(~ran))


def run_incremental(source: DataFrame, target_path: str, log_path: str, completed_at: str, order: list, late_days: int = 0) -> dict:
    """One run: read what is new since each repository's last run, insert the
    rows that the target lacks (U1), then log the run.  Rows that come up to
    ``late_days`` late are still taken.  A run that ends before its log lines
    are written is done over by the next one, which finds its rows there."""
    spark = source.sparkSession
    batch = since_last_run(source, last_runs(spark, log_path), late_days)
    known = child_names(spark, target_path)
    target = spark.read.schema(CHANGES).parquet(target_path) if known else spark.createDataFrame([], CHANGES)
    seen = Observation()
    rows = insert_new(target, batch, KEYS, order).select(*[f.name for f in CHANGES.fields])
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*REPO).parquet(target_path)
    runs = source.select(*REPO).distinct().select(*REPO, F.lit("last_completed").alias("key"), F.lit(completed_at).alias("value"))
    append_runs(runs, log_path)
    return {"inserted": seen.get["n"]}


def rebuild(rows: DataFrame, path: str, repos: list[tuple[str, str]] | None = None) -> None:
    """Replace the repositories that ``rows`` hold, and of ``repos`` those
    that have no rows any more; all others stay as they are (U7).

    The new partitions are written beside the table and moved in when all are
    complete, so a run that fails leaves the old rows."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*REPO).parquet(path)
    if repos:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in REPO])
        empty = spark.createDataFrame(repos, schema).join(rows.select(*REPO), list(REPO), "left_anti").collect()
        jvm = spark._jvm
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for r in empty:
            gone = jvm.org.apache.hadoop.fs.Path(path, f"repo_owner={escape(r['repo_owner'])}/repo_name={escape(r['repo_name'])}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
