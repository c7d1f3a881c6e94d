"""Dedup of 200-byte strings with a logarithmic family of indexes of minimiser fingerprints.

A suffix array over every byte would be eight times the text, and there is none here.  The levels hold (key, n): the 64-bit
fingerprint of the 32 bytes at a minimiser of some 200-byte window, about one place in 85, and how often it occurs.  Every
repeated string of 200 bytes contains a minimiser at the same place.  Which places with equal keys also agree over 200
bytes is settled on the bytes, by super-k-mers (``repeats``).

A new batch gets its own table.  It is joined by key with every level, and then merged with the level of its size, that one
with the next, and so on, so that a key is rewritten once per doubling.  Levels are tables bucketed and sorted by the key:
joins and merges go bucket by bucket, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import bucketed, discard, written
from .repeats import Bytes

BATCH_RUNS = 1 << 22  # runs of a batch, about 600 MB of text, until the corpus has MOST_BATCHES of them; then batches grow
MOST_BATCHES = 16


class SuffixIndex:
    """The levels: ``levels[rank]`` holds (key, n) for about 2 ** rank batches, n the number of such suffixes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.tables = spark, {}, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _table(self, df: DataFrame) -> str:
        out = bucketed(df, "suffixes", "key", self.buckets)
        self.tables[out.table] = out
        return out.table

    def _drop(self, name: str) -> None:
        discard(self.spark, self.tables.pop(name))

    def append(self, suffixes: DataFrame) -> DataFrame:
        """Add the batch's suffixes (key); returns the keys that occur twice in it or also in a level, each once at least."""
        new = self._table(suffixes.groupBy("key").agg(F.count("*").alias("n")))
        found = self.spark.table(new).where("n > 1").select("key")
        for level in self.levels.values():
            found = found.unionAll(self.spark.table(new).join(self.spark.table(level), "key", "left_semi").select("key"))
        found = written(found, "suffix_matches")
        rank = 0
        while rank in self.levels:
            old, run = self.levels.pop(rank), new
            a, b = self.spark.table(old), self.spark.table(run).select("key", F.col("n").alias("m"))
            new = self._table(a.join(b, "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))
            for gone in (old, run):
                self._drop(gone)
            rank += 1
        self.levels[rank] = new
        return found

    def drop(self) -> None:
        for name in [*self.tables]:
            self._drop(name)
        self.levels = {}


def _apply(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    out = b"".join(kept)
    return out, len(raw), len(raw) - len(out), len(spans)


def _apply_text(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    """As ``_apply``, without what is left of a character that a span cuts through."""
    out, *numbers = _apply(raw, spans)
    return out.decode("utf-8", "ignore").encode(), *numbers


def _shared(found: DataFrame, batches: int | None) -> DataFrame:
    """Written: the keys that occur twice in ``found``, which comes to the index in batches of neighbouring input partitions."""
    spark = found.sparkSession
    n, parts = found.agg(F.count("*"), F.max("part")).first()
    batches = batches or min(MOST_BATCHES, -(-n // BATCH_RUNS))
    edges = [i * ((parts or 0) + 1) // max(batches, 1) for i in range(max(batches, 1) + 1)]
    index, matched = SuffixIndex(spark), []
    try:
        for lo, hi in zip(edges, edges[1:]):
            matched.append(index.append(found.where((F.col("part") >= lo) & (F.col("part") < hi)).select("key")))
    finally:
        index.drop()
    shared = matched[0]
    for m in matched[1:]:
        shared = shared.unionAll(m)
    # Written before the join: of two bare shuffles Spark can split the rows of a frequent key.
    out = written(shared.distinct(), "shared_keys") if batches > 1 else matched[0]
    discard(spark, *(matched if batches > 1 else []))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None, as_text: bool = False) -> DataFrame:
    """row (the whole input row), kept (the bytes that stay), n_units (bytes), n_removed, n_spans (maximal removed runs).
    With ``as_text``, ``kept`` is a string, without the rest of a character that a span cuts through.

    A byte goes if a string of 200 bytes that covers it also starts anywhere else, in the same document or another; what
    is left of other documents doesn't matter.  Null, empty and short texts lose nothing; null gives an empty ``kept``.
    Rows with a null id lose nothing and make none lose any.  Rows that repeat an id and its text are other places each, so
    they lose all that they share.  A very long text is looked at in slices, whole.  An empty table gives no rows.  All
    columns stay in ``row``, whatever their names.  ``batches`` fixes the number of batches, which else follows the input.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = written(repeats.runs(plain, Bytes).withColumn("part", F.spark_partition_id()), "byte_runs")
    shared = _shared(found, batches)
    runs = written(found.drop("part").join(shared, "key", "left_semi"), "shared_runs")
    discard(docs.sparkSession, found, shared)
    classes = runs.groupBy("key", "cls").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "tag", "at", "n")).alias("rep"))
    classes = written(classes.select("key", "cls", "copies", "rep.*"), "run_classes")
    # A key's classes need a look at their bytes only if one of them has a single copy.
    many = classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("copies").alias("fewest")).where("classes > 1 and fewest = 1")
    # One shuffle of the texts serves both joins on the document.
    texts = repeats.zipped(docs, id_col, text_col)
    strings = repeats.packed(texts, classes.join(many.select("key", "classes"), "key"), Bytes)
    partial = repeats.compare(strings, Bytes, ranked=False)
    whole = (runs.join(classes.where("copies > 1").select("key", "cls"), ["key", "cls"], "left_semi")
             .select("doc_id", "tag", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + Bytes.width).alias("b")))
    single = classes.where("copies = 1").select("key", "cls", "doc_id", "tag", "at")
    part = partial.join(single, ["key", "cls"]).select("doc_id", "tag", (F.col("at") + F.col("place")).alias("a"),
                                                        (F.col("at") + F.col("place") + F.col("count") - 1 + Bytes.width).alias("b"))
    return repeats.cut(texts, docs.columns, text_col, whole.unionAll(part), "string" if as_text else "binary", _apply_text if as_text else _apply)
