"""Churn per file and the churn directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import REPO
from ..functions.text import COLORS, resolve_rename


def file_churn(changes: DataFrame) -> DataFrame:
    """Sum of churn per file over described rows."""
    return (changes.filter(F.col("description").isNotNull())
            .groupBy(*REPO, "filename")
            .agg(F.sum("churn_count").alias("total_churn")))


def churn_tree(changes: DataFrame) -> DataFrame:
    """Directory tree of churn (A12): one row per node.

    Columns: path (``a/b``), parent (NULL for top-level nodes), name,
    depth (1 = top level), color (palette cycled by depth), is_file, churn
    (file: its churn; directory: the sum below it).  The root node ``repo``
    has path '' and depth 0.  A path that is both a file and a directory
    keeps both nodes (is_file tells them apart).

    Per-file sums come first, so the prefix explode multiplies the number of
    distinct files by their depth, not the number of change rows; position 0
    of the explode is the root, so one aggregation yields every node.
    """
    files = file_churn(changes).withColumn("_parts", F.split("filename", "/"))
    i = F.col("_i")
    parts = F.col("_parts")
    palette = F.array(*[F.lit(c) for c in COLORS])
    nodes = files.select(*REPO, "total_churn", "_parts",
                         F.explode(F.sequence(F.lit(0), F.size("_parts"))).alias("_i"))
    nodes = nodes.select(
        *REPO, "total_churn",
        F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), "/"))
         .alias("path"),
        F.when(i > 1, F.array_join(F.slice(parts, 1, F.greatest(i - 1, F.lit(1))), "/")).alias("parent"),
        F.when(i == 0, F.lit("repo")).otherwise(F.element_at(parts, F.greatest(i, F.lit(1)))).alias("name"),
        i.cast("int").alias("depth"),
        F.when(i > 0, F.element_at(palette, ((i - 1) % len(COLORS)) + 1)).alias("color"),
        ((i > 0) & (i == F.size(parts))).alias("is_file"))
    return (nodes.groupBy(*REPO, "path", "parent", "name", "depth", "color", "is_file")
            .agg(F.sum("total_churn").alias("churn"))
            .select(*REPO, "path", "parent", "name", "depth", "color", "is_file", "churn"))


def directory_commits(changes: DataFrame, levels: int | None = None) -> DataFrame:
    """Distinct-commit counts per file summed per directory, after resolving
    rename notation; directory cut to ``levels`` components (A19)."""
    per_file = (changes.withColumn("filename", resolve_rename("filename"))
                .groupBy(*REPO, "filename")
                .agg(F.countDistinct("commit_hash").alias("commits")))  # renames may merge files
    parts = F.split("filename", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    if levels is not None:
        dirs = F.slice(dirs, 1, F.lit(levels))
    return (per_file.withColumn("directory", F.array_join(dirs, "/"))
            .groupBy(*REPO, "directory").agg(F.sum("commits").alias("commits")))
