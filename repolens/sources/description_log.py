"""Description log (S4, S5): ``time<TAB>file<TAB>hash<TAB>text`` where the
text may span lines.  A line starting with ``YYYY-MM-DD HH:MM:SS<TAB>``
starts a record; other lines continue the current one; text before the
first record is dropped.  Appends are numbered by their folder
(``append=<n>``); files outside of one are ordered by their file time.

Scale: lines are read with the splittable line reader.  Each line is
assigned to the last record start at or before it *within its file split*
(a window per split, bounded by the split size); lines at the head of a
split before its first start belong to the last record of the previous
split of the same file, found on a table with one row per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import REPO
from ..session import child_names
from .commit_log import text_reader, with_repo

START = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\t"


def read_description_log(spark: SparkSession, path: str, repo_owner: str | None = None,
                         repo_name: str | None = None) -> DataFrame:
    number = F.regexp_extract("_metadata.file_path", "/append=(\\d+)/", 1)
    lines = with_repo(text_reader(spark.read, repo_owner, repo_name).text(path), repo_owner, repo_name).select(
        *REPO, F.col("_metadata.file_path").alias("source_file"),
        F.when(number != "", number.try_cast("bigint"))
         .otherwise(F.unix_micros(F.col("_metadata.file_modification_time"))).alias("appended_at"),
        F.monotonically_increasing_id().alias("pos"), "value")
    # split id = partition index carried in the upper bits of the id
    lines = lines.withColumn("split", F.shiftright("pos", 33)).withColumn(
        "is_start", F.col("value").rlike(START))
    w = (Window.partitionBy("source_file", "split").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("rec", F.max(F.when(F.col("is_start"), F.col("pos"))).over(w))
    # carry-over for split heads: last start of any earlier split of the file
    last = lines.groupBy("source_file", "split").agg(
        F.max(F.when(F.col("is_start"), F.col("pos"))).alias("_last"))
    ws = (Window.partitionBy("source_file").orderBy("split")
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = last.select("source_file", "split", F.max("_last").over(ws).alias("_carry"))
    lines = (lines.join(carry, ["source_file", "split"], "left")
             .withColumn("rec", F.coalesce("rec", "_carry"))
             .filter(F.col("rec").isNotNull()))
    recs = (lines.groupBy(*REPO, "source_file", "appended_at", "rec")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_ls")))
    text = F.array_join(F.transform("_ls", lambda s: s["value"]), "\n")
    cells = F.split(text, "\t", 4)
    return recs.select(
        *REPO,
        F.element_at(cells, 1).try_cast("timestamp_ntz").alias("logged_at"),
        F.element_at(cells, 2).alias("filename"),
        F.element_at(cells, 3).alias("commit_hash"),
        F.coalesce(F.get(cells, 3), F.lit("")).alias("text"),
        "source_file", "appended_at", F.col("rec").alias("position"))


def render_descriptions(df: DataFrame) -> DataFrame:
    """Rows (logged_at, filename, commit_hash, text) as log records."""
    cells = [F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss"), F.col("filename"), F.col("commit_hash"), F.col("text")]
    return df.select(*REPO, F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cells]).alias("value"))


def append_descriptions(df: DataFrame, path: str) -> None:
    """Append records to the log (S5).  Each append is a numbered folder, so
    that its order does not hang on file times, which copying or restoring a
    log changes; a log that was begun without numbers goes on without."""
    names = child_names(df.sparkSession, path)
    if not any(n.startswith("repo_owner=") for n in names):
        done = [int(n.removeprefix("append=")) for n in names if n.startswith("append=")]
        path = f"{path}/append={max(done, default=0) + 1:08d}"
    render_descriptions(df).write.mode("append").partitionBy(*REPO).text(path)
