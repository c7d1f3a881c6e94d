"""Substring dedup over windows of 50 words, by super-k-mer partitioning.

Consecutive windows that share their minimiser travel as one packed string to the minimiser's bucket, where sorting their
windows counts them exactly (``repeats``).  Before anything travels, runs whose minimiser stands in one document only are
left behind, and runs of equal content are sent once, for the smallest document that has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import discard, written
from .repeats import Words


def _apply(raw: bytes, spans: list[tuple[int, int]]) -> tuple:
    words = raw.split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return b" ".join(kept), len(words), len(words) - len(kept), len(spans)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the whole input row), kept (the words that stay, joined by one space), n_units (words), n_removed, n_spans.

    A word goes if a window of 50 consecutive words that covers it also starts in a document with a smaller id.  Null,
    empty and short texts lose nothing; null gives an empty ``kept``.  Rows with a null id neither lose words nor make
    others lose any.  Rows that repeat an id count as one document.  All columns stay in ``row``, whatever their names.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = written(repeats.runs(plain, Words), "word_runs")
    shared = found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    # Written before the join: of two bare shuffles Spark can split the rows of a frequent key.
    shared = written(shared, "shared_keys")
    runs = written(found.join(shared, "key", "left_semi"), "shared_runs")
    discard(docs.sparkSession, found, shared)
    classes = runs.groupBy("key", "cls").agg(F.min(F.struct("doc_id", "tag", "at", "n")).alias("rep"))
    classes = written(classes.select("key", "cls", "rep.*"), "run_classes")
    many = classes.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1")
    # One shuffle of the texts serves both joins on the document.
    texts = repeats.zipped(docs, id_col, text_col)
    strings = repeats.packed(texts, classes.join(many, "key"), Words)
    partial = repeats.compare(strings, Words, ranked=True)
    owner = classes.select(F.col("key").alias("k"), F.col("cls").alias("c"), F.col("doc_id").alias("least"))
    # A copy of a class in a larger document goes whole; its first document loses what other classes show.
    held = runs.join(owner, (F.col("key") == F.col("k")) & (F.col("cls") == F.col("c")))
    whole = held.where("doc_id > least").select("doc_id", "tag", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + Words.width).alias("b"))
    first = held.where("doc_id = least").select("key", "cls", "doc_id", "tag", "at")
    part = partial.join(first, ["key", "cls"]).select("doc_id", "tag", (F.col("at") + F.col("place")).alias("a"),
                                                       (F.col("at") + F.col("place") + F.col("count") - 1 + Words.width).alias("b"))
    return repeats.cut(texts, docs.columns, text_col, whole.unionAll(part), "string", _apply)
