"""The catalogue queries shipped with the schema description (R8: K1-K15)
and the schema description itself as a table (R9).  "Now" is an ``as_of``
argument so results repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import REPO
from ..plans.helpers import top_n
from ..schemas import FILES, TABLES
from . import pulls as P


def tag_rows(ctags: DataFrame, tag_id: int) -> DataFrame:                      # K1
    return ctags.filter(F.col("tag_id") == tag_id)


def top_tag_changes(ctags: DataFrame, tag_id: int, key: list[str], n: int = 10) -> DataFrame:  # K2
    rows = ctags.filter(F.col("tag_id") == tag_id)
    return top_n(rows, list(REPO), [F.desc("value"), *[F.asc(k) for k in key]], n)


def changes_by_author(changes: DataFrame, author: str) -> DataFrame:          # K3
    return changes.filter(F.col("author") == author)


def files_changed_since(changes: DataFrame, as_of: str, days: int = 30) -> DataFrame:  # K4
    lo = F.date_sub(F.to_date(F.lit(as_of)), days).cast("timestamp_ntz")
    return changes.filter(F.col("committed_at") > lo).select(*REPO, "filename")


def churn_above(changes: DataFrame, x: int) -> DataFrame:                    # K5
    return changes.filter(F.col("churn_count") > x)


def tag_names(tags: DataFrame) -> DataFrame:                                  # K6
    return tags.select(*REPO, "name")


def tag_id(tags: DataFrame, name: str) -> DataFrame:                          # K7
    return tags.filter(F.col("name") == name).select(*REPO, "tag_id")


def summary_names(summaries: DataFrame) -> DataFrame:                         # K13
    return summaries.select(*REPO, "name").distinct()


def summaries_by_model(summaries: DataFrame, model: str) -> DataFrame:        # K14
    return summaries.filter(F.col("ai_model") == model)


def summaries_in_range(summaries: DataFrame, start: str, end: str) -> DataFrame:  # K15
    return summaries.filter((F.col("start_date") >= F.lit(start).cast("timestamp_ntz"))
                            & (F.col("end_date") <= F.lit(end).cast("timestamp_ntz")))


CATALOGUE = {
    "tag_rows": tag_rows, "top_tag_changes": top_tag_changes,
    "changes_by_author": changes_by_author, "files_changed_since": files_changed_since,
    "churn_above": churn_above, "tag_names": tag_names, "tag_id": tag_id,
    "open_pulls": P.open_pulls, "merged_since": P.merged_since, "pulls_by_user": P.pulls_by_user,
    "merge_hours": P.merge_hours, "pulls_titled": P.pulls_titled,
    "summary_names": summary_names, "summaries_by_model": summaries_by_model,
    "summaries_in_range": summaries_in_range,
}


def catalogue(name: str, /, *tables: DataFrame, **params) -> DataFrame:
    """Run catalogue query ``name`` on its table(s) with parameters."""
    return CATALOGUE[name](*tables, **params)


def describe_schema(spark: SparkSession) -> DataFrame:
    """Tables, columns, types and meaning as a table (R9), from the schemas themselves."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable, f.metadata["meaning"], doc)
            for t, (schema, doc) in TABLES.items() for f in schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, "
                                       "meaning string, table_description string")


def profile(table: str, rows: DataFrame) -> DataFrame:
    """Columns of a table with type and meaning, and what its rows hold of
    them: rows and non-null values (R9).  One pass, one row per column."""
    schema, _ = (TABLES | FILES)[table]
    counts = [F.count(F.col(f.name)).alias(f.name) for f in schema.fields]
    one = rows.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    columns = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                                 F.lit(f.metadata["meaning"]).alias("meaning"), F.col(f.name).alias("filled")) for f in schema.fields])
    return one.select(F.lit(table).alias("table"), F.col("_rows").alias("rows"), F.inline(columns))
