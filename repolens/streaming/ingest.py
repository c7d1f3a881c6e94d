"""Incremental file intake (U9): new commit-log files are picked up once,
parsed by S1 and inserted by U1 into a parquet ``changes`` table.

``readStream`` text source with ``lineSep='^^'`` + ``foreachBatch`` +
``trigger(availableNow=True)``.  An epoch parses its files once; what it
inserts and what it rejects are written to folders of their own, named after
the stream and the epoch::

    <target>/epoch=<stream>-<n>/repo_owner=<o>/repo_name=<n>/...
    <rejects>/epoch=<stream>-<n>/...

A replayed epoch (after a failure between write and commit) overwrites its own
folders and does not take their old content for rows that are there already,
so it leaves the same rows and rejects, however often it runs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import REPO
from ..operators.load import insert_new, insert_new_near
from ..schemas import CHANGES
from ..session import child_names, cut_lineage
from ..sources.commit_log import RECORD_SEP, parse_commit_lines, split_rejects, text_reader, with_repo

KEYS = [*REPO, "commit_hash", "filename"]
ORDER = ["source_file", "record_pos", "line_no"]
TARGET = T.StructType([*CHANGES.fields, T.StructField("epoch_id", T.StringType())])
# Repositories of a batch up to this number prune the target by a list.
MOST_LISTED = 1000
# A batch of up to this many rows is broadcast to the target.  The rows of a
# larger one are shuffled by commit, but for groups of commits of very many
# rows: a repeated commit is reduced before the shuffle.
SMALL_BATCH, COMMIT_GROUPS, MOST_IN_GROUP = 100_000, 8192, 500_000


def read_target(spark: SparkSession, path: str, without_epoch: str | None = None, repos: list | None = None) -> DataFrame:
    """The inserted rows, by epochs and repositories that the scan prunes."""
    if not child_names(spark, path):
        return spark.createDataFrame([], TARGET)
    rows = spark.read.schema(TARGET).parquet(path)
    if without_epoch is not None:
        rows = rows.filter(F.col("epoch_id") != without_epoch)
    if repos is not None:
        rows = rows.filter(F.col("repo_owner").isin([r[0] for r in repos]) & F.col("repo_name").isin([r[1] for r in repos]))
    return rows


def _commit_group():
    return F.pmod(F.xxhash64(*REPO, "commit_hash"), F.lit(COMMIT_GROUPS))


def _new_rows(target: DataFrame, changes: DataFrame, sizes: dict) -> DataFrame:
    """The rows of ``changes`` to insert; ``sizes``: rows by group of commits."""
    total = sum(sizes.values())
    if total <= SMALL_BATCH:
        return insert_new(target, changes, KEYS, ORDER)
    most = max(MOST_IN_GROUP, 8 * total // COMMIT_GROUPS)
    heavy = [g for g, n in sizes.items() if n > most]
    if not heavy:
        return insert_new_near(target, changes, KEYS, ORDER, [*REPO, "commit_hash"])
    is_heavy = _commit_group().isin(heavy)
    near = insert_new_near(target.filter(~is_heavy), changes.filter(~is_heavy), KEYS, ORDER, [*REPO, "commit_hash"])
    return near.unionByName(insert_new(target.filter(is_heavy), changes.filter(is_heavy), KEYS, ORDER))


def _after_write(epoch: str) -> None:
    """Called when an epoch is written and not committed yet (tests end the run here)."""


def ingest_stream(spark: SparkSession, source_dir: str, target_path: str, checkpoint: str,
                  repo_owner: str | None = None, repo_name: str | None = None,
                  exclude_files: str = "", exclude_authors: str = "",
                  max_files_per_trigger: int | None = None, rejects_path: str | None = None) -> dict:
    """Run the intake until every file present now is processed; returns the
    numbers of rows inserted, skipped (there already) and rejected, and of
    batches.  Rejects go to ``rejects_path`` (default: ``<target>-rejects``)."""
    stats = {"inserted": 0, "skipped": 0, "rejected": 0, "batches": 0}
    rejects_path = rejects_path or target_path.rstrip("/") + "-rejects"
    reader = text_reader(spark.readStream, repo_owner, repo_name).option("lineSep", RECORD_SEP)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.text(source_dir)

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        # the stream's own id: another checkpoint is another stream
        stream_id = json.loads(session.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        epoch = f"{stream_id}-{number}"
        recs = with_repo(df, repo_owner, repo_name).select(
            *REPO, F.input_file_name().alias("source_file"),
            F.monotonically_increasing_id().alias("record_pos"), "value")
        # the batch is parsed once, here
        lines = cut_lineage(parse_commit_lines(recs, exclude_files, exclude_authors))
        changes, rejects = split_rejects(lines)
        sizes = cut_lineage(lines.groupBy(*REPO, _commit_group().alias("group")).agg(F.count(F.when(F.col("kind").isNull(), 1)).alias("n")))
        repos = [tuple(r) for r in sizes.select(*REPO).distinct().limit(MOST_LISTED + 1).collect()]
        sizes = {r["group"]: r["n"] for r in sizes.groupBy("group").agg(F.sum("n").alias("n")).collect()}
        target = read_target(session, target_path, epoch, repos if len(repos) <= MOST_LISTED else None)
        new = _new_rows(target, changes, sizes)
        counts = {name: Observation(f"{name}-{epoch}") for name in ("inserted", "rejected")}
        (new.select(*[f.name for f in CHANGES.fields]).observe(counts["inserted"], F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").option("compression", "zstd").partitionBy(*REPO).parquet(f"{target_path}/epoch_id={epoch}"))
        (rejects.observe(counts["rejected"], F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{rejects_path}/epoch_id={epoch}"))
        _after_write(epoch)
        stats["batches"] += 1
        for name, seen in counts.items():
            stats[name] += seen.get["n"]
        stats["skipped"] += sum(sizes.values()) - counts["inserted"].get["n"]

    q = (stream.writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stats
