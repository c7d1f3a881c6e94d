"""Plumbing of the operators: tables of a run, scans in Python, components of a link table."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of an Arrow batch that goes to a Python stage: whole texts travel, so far fewer than Spark's default.
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below spark.checkpoint.dir, and read again.  What is read more than once is
    neither computed twice nor lost with an executor."""
    path = scratch_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _stage_tables is not None:
        _stage_tables.append(path)
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written once as a table below spark.checkpoint.dir, bucketed by ``key``: it is joined and grouped by the key
    without a shuffle of its rows."""
    name = f"{name}_{uuid.uuid4().hex}"
    path = scratch_path(df.sparkSession, f"llm/{name}")
    (df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    out = df.sparkSession.table(name)
    out.scratch, out.table = path, name
    if _stage_tables is not None:
        _stage_tables.append(path)
    return out


#: Tables written while a pipeline stage is being built (None outside one), and those of the stage built last.
_stage_tables: list[str] | None = None
_last: list[str] = []


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete ``written`` and ``bucketed`` tables that no later step reads, so that scratch space doesn't pile up."""
    for t in tables:
        if hasattr(t, "table"):
            spark.sql(f"drop table if exists {t.table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(fn):
    """A pipeline stage.  Its result is written before the next stage is called, so each call first deletes the tables that the
    stage before it has worked with."""
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _stage_tables
        discard(spark, *_last)
        _last.clear()
        _stage_tables = made = []
        try:
            return fn(spark, docs, sf_dir)
        finally:
            _stage_tables = None
            _last[:] = made
    return run


def scan(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over the Arrow batches of ``df``, where its rows lie: no shuffle."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(fn, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
          "double": pa.float64(), "float": pa.float32(), "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL text (there is no Spark session inside a task)."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def pack(raw: bytes) -> bytes:
    """``raw`` compressed, behind its length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows whose crc32 of the id as text leaves ``part`` modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


LEAST_FILES, LINKS_OF_FILE = 8, 1 << 20


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a link table: (node, root) for every node of a link, root the smallest node reachable.

    Alternating large-star and small-star steps; each round is a table in the shared folder, and only the numbers of
    changed links come to the driver.  A node of any degree is aggregated map-side before the shuffle."""
    spark = links.sparkSession
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
             .distinct())
    edges = written(edges, "links")
    n, last = edges.count(), None
    while True:
        # As many files a round as the links need, not as many as there are shuffle partitions.
        files = max(LEAST_FILES, -(-n // LINKS_OF_FILE))
        # Large star: every node hands its larger neighbours to its smallest one.
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = written(large.coalesce(files), "large")
        # Small star: every node hands itself and its smaller neighbours to its smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = written(small.coalesce(files), "small")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == last:
            break
        n, last = now[0], now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a key made from id and whole text, and the name of its column.  It tells apart rows that share an id but
    not their text, and rows without an id; decisions about rows travel by it."""
    name = "row_key"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    return docs.withColumn(name, F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))), name


#: Ids up to this number are broadcast, 16 bytes each; a longer list is joined by a shuffle.
MOST_IDS = 2_000_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``ids``; rows with a null id stay."""
    ids = written(ids.select(F.col(ids.columns[0]).alias("gone_id")).distinct(), "gone_ids")
    few = ids.count() <= MOST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col("gone_id"), "left_anti")
