"""Cost log, price list and run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import REPO
from ..schemas import COST_LOG, RUN_LOG

PRICING_TYPE = "map<string,map<string,struct<input:double,output:double>>>"


def read_cost_log(spark: SparkSession, path: str) -> DataFrame:
    """Cost log (S6): tab-separated ``date model input output cost``; lines
    starting with ``#`` skipped; rows need more than 4 cells."""
    raw = spark.read.text(path)
    cells = F.split(F.trim(F.col("value")), "\t")
    return (raw.filter(~F.col("value").startswith("#"))
            .select(cells.alias("_c")).filter(F.size("_c") > 4)
            .select(F.element_at("_c", 1).alias("date"), F.element_at("_c", 2).alias("model"),
                    F.element_at("_c", 3).try_cast("bigint").alias("input"),
                    F.element_at("_c", 4).try_cast("bigint").alias("output"),
                    F.element_at("_c", 5).cast("double").alias("cost")))


def append_costs(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *[F.col(f.name).cast("string") for f in COST_LOG.fields])
              .alias("value")).write.mode("append").text(path)


def cost_to_date(log: DataFrame) -> DataFrame:
    """Total logged cost (A16), summed as an exact decimal."""
    return log.agg(F.coalesce(F.sum(F.col("cost").cast("decimal(20,10)")),
                              F.lit(0).cast("decimal(30,10)")).alias("cost_to_date"))


def read_pricing(spark: SparkSession, path: str) -> DataFrame:
    """Price list JSON -> (service, model, input, output) USD per 1M tokens.
    The list is a small config document read whole."""
    doc = spark.read.text(path, wholetext=True)
    m = doc.select(F.from_json("value", PRICING_TYPE).alias("m"))
    s = m.select(F.explode("m").alias("service", "models"))
    return s.select("service", F.explode("models").alias("model", "p")).select(
        "service", "model", F.col("p.input").alias("input"), F.col("p.output").alias("output"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run log (S11): rows need exactly 4 tab-separated fields."""
    raw = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("pos"), F.split("value", "\t").alias("_c"))
    return raw.filter(F.size("_c") == 4).select(
        "pos", *[F.trim(F.element_at("_c", i + 1)).alias(f.name) for i, f in enumerate(RUN_LOG.fields)])


def append_runs(runs: DataFrame, path: str) -> None:
    """Log lines of finished runs: repo, key, value."""
    (runs.select(F.concat_ws("\t", *[f.name for f in RUN_LOG.fields]).alias("value"))
     .coalesce(1).write.mode("append").text(path))


def append_run(spark: SparkSession, path: str, repo_owner: str, repo_name: str, key: str,
               when_iso: str) -> None:
    append_runs(spark.createDataFrame([(repo_owner, repo_name, key, when_iso)], RUN_LOG), path)


def last_run(runs: DataFrame) -> DataFrame:
    """Latest ``last_completed`` time per repository, as ``MM/dd/yyyy``
    (S11).  Runs are appended as they complete, so the latest time is the
    last line, in whatever order the files are scanned."""
    done = runs.filter(F.col("key") == "last_completed")
    return (done.groupBy(*REPO).agg(F.max(F.col("value").try_cast("timestamp_ntz")).alias("_v"))
            .select(*REPO, F.date_format("_v", "MM/dd/yyyy").alias("last_run")))


def list_repos(changes: DataFrame) -> DataFrame:
    """Repositories present in a table."""
    return changes.select(*REPO).distinct()
