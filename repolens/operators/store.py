"""Content-addressed store of model answers and vectors.

One table per store, keyed by the sha256 of model and prompt (or text), as
Parquet bucketed by the key.  Work that is still to do is an anti join by the
key, and answers are read back by a join: both run bucket by bucket, the
store itself is never shuffled, however large it grows.

The table is registered in the session's catalog under a name made from its
path; the folder below the path says how many buckets it has, so every
session and cluster that opens it agrees.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

COLUMNS = ("key string, model string, prompt string, answer string, vector array<double>, "
           "prompt_tokens bigint, completion_tokens bigint")
LEAST_BUCKETS = 16
# A chunk of kept rows is up to 2 ** CHUNK_BITS rows of one input partition.
CHUNK_BITS = 10
PLACE = ["_chunk", "_row"]


def content_key(model: str, content: Column) -> Column:
    """sha256 of model and content."""
    return F.sha2(F.concat(F.lit(model), F.lit("\u0001"), content), 256)


def open_store(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """The name of the store's table; a new store gets ``buckets`` buckets,
    by default as many as the session has shuffle partitions (at least
    ``LEAST_BUCKETS``)."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/buckets-*")) or []
    if len(found) > 1:
        raise ValueError(f"{path} holds more than one store")
    if found:
        place = found[0].getPath()
        n = int(place.getName().rsplit("-", 1)[1])
    else:
        n = buckets or max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        place = jvm.org.apache.hadoop.fs.Path(root, f"buckets-{n}")
        fs.mkdirs(place)
    qualified = str(fs.makeQualified(root).toUri())
    name = "store_" + hashlib.md5(qualified.encode()).hexdigest()
    quoted = f"{qualified.rstrip('/')}/{place.getName()}".replace("'", "\\'")
    spark.sql(f"create table if not exists {name} ({COLUMNS}) using parquet options (compression 'zstd') "
              f"clustered by (key) sorted by (key) into {n} buckets location '{quoted}'")
    return name


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All entries as of now."""
    name = open_store(spark, path)
    spark.catalog.refreshTable(name)          # another session may have added files
    return spark.table(name)


def missing(wanted: DataFrame, path: str, got: Column) -> DataFrame:
    """Rows of ``wanted`` (with ``key``) that have no entry where ``got`` holds."""
    have = read_store(wanted.sparkSession, path).filter(got).select("key")
    return wanted.join(have, "key", "left_anti")


def _buckets(spark: SparkSession, name: str) -> int:
    return int(spark.sql(f"describe table extended {name}").filter("col_name = 'Num Buckets'").first()["data_type"])


def deal(rows: DataFrame, path: str) -> DataFrame:
    """Rows with a ``key``, dealt as the store's buckets are."""
    spark = rows.sparkSession
    return rows.repartition(_buckets(spark, open_store(spark, path)), "key")


def for_calls(rows: DataFrame, path: str, callers: int | None = None) -> tuple[DataFrame, bool]:
    """Rows with a ``key``, dealt to at most ``callers`` tasks, by default to two a core or more, and whether they are dealt
    as the store's buckets are: then what the tasks make of them is appended as it is, in one shuffle instead of two."""
    spark = rows.sparkSession
    least = spark.sparkContext.defaultParallelism * 2
    if callers or _buckets(spark, open_store(spark, path)) < least:
        return rows.repartition(callers or least, "key"), False
    return deal(rows, path), True


def append(entries: DataFrame, path: str, dealt: bool = False) -> None:
    """Add entries; columns that they lack are NULL.  ``dealt``: each task's
    rows come from ``deal``."""
    spark = entries.sparkSession
    name = open_store(spark, path)
    row = [F.col(f.name) if f.name in entries.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.table(name).schema.fields]
    # Dealt as the buckets are: a task writes one file.
    (entries if dealt else deal(entries, path)).select(*row).write.mode("append").insertInto(name)


def entries_of(wanted: DataFrame, path: str, value: str) -> DataFrame:
    """(key, value): the least stored value of each key of ``wanted`` that has one.  Cut off the store: a plan that reads it
    twice, before and after an append, would else take both for one."""
    stored = read_store(wanted.sparkSession, path).filter(F.col(value).isNotNull()).select("key", value)
    return cut_lineage(stored.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min(value).alias(value)))


# Tables of kept rows made inside each ``drop_kept_rows`` that is open: (name, path).
_open: list[list[tuple[str, str]]] = []


@contextlib.contextmanager
def drop_kept_rows(spark: SparkSession):
    """On leaving, the tables of kept rows that were made inside are deleted: for results that are computed by then, so
    that the scratch space of one run after another doesn't pile up.  Stores are kept."""
    _open.append([])
    try:
        yield
    finally:
        for name, path in _open.pop():
            spark.sql(f"drop table if exists {name}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class KeptRows:
    """Rows with a ``_key``, written once, and numbered (``_row``): a table bucketed by chunks of the numbers.  Entries come
    to the rows by chunk, and the rows, with their texts, stay where they lie."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        name, number = f"rows_{uuid.uuid4().hex}", F.monotonically_increasing_id()
        self.buckets = max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        void = [f.name for f in rows.schema.fields if f.dataType.typeName() == "void"]   # Parquet has no such type
        path = scratch_path(spark, name)
        for made in _open[-1:]:
            made.append((name, path))
        (rows.drop(*void).select("*", F.shiftright(number, CHUNK_BITS).alias("_chunk"), number.alias("_row"))
         .write.format("parquet").option("compression", "zstd").option("path", path)
         .bucketBy(self.buckets, "_chunk").saveAsTable(name))
        self.table = spark.table(name)
        if void:
            self.table = self.table.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in [*rows.columns, *PLACE]])

    def _met(self, values: DataFrame, value: str, how: str) -> DataFrame:
        # one list a chunk, which has a bounded number of rows
        lists = (values.repartition(self.buckets, "_chunk").groupBy("_chunk")
                 .agg(F.map_from_entries(F.collect_list(F.struct("_row", f"`{value}`"))).alias("_found")))
        return self.table.join(lists, "_chunk", how)

    def picked(self, values: DataFrame, value: str) -> DataFrame:
        """The rows whose places are in ``values``, with its column ``value``."""
        met = self._met(values, value, "inner").filter(F.map_contains_key("_found", F.col("_row")))
        return met.select("*", F.try_element_at("_found", F.col("_row")).alias(value)).drop("_found")

    def given(self, values: DataFrame, value: str) -> DataFrame:
        """All rows, with the column ``value`` that ``values`` has for their places, else NULL."""
        return self._met(values, value, "left").select("*", F.try_element_at("_found", F.col("_row")).alias(value)).drop("_found")

    def missing(self, path: str, got: Column) -> DataFrame:
        """The key, as ``_asked``, and place of the first row of each key that has no entry where ``got`` holds."""
        wanted = self.table.groupBy(F.col("_key").alias("key")).agg(F.min("_row").alias("_row"))
        return cut_lineage(missing(wanted, path, got).select(F.col("key").alias("_asked"), F.shiftright("_row", CHUNK_BITS).alias("_chunk"), "_row"))

    def entries(self, path: str, value: str) -> DataFrame:
        """``entries_of`` the rows' keys."""
        return entries_of(self.table.select(F.col("_key").alias("key")).distinct(), path, value)
