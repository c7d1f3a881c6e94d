"""The corpus pipeline: documents through the filters and into the mixture, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below spark.checkpoint.dir
and hands the reread table to the next stage.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import decontaminate, jaccard_join, language_id, mixing, suffix_levels
from repolens.llm.common import documents, keyed, stage, without_ids, written

#: The cosine of texts that have nothing to do with a language scatters around 0 by 1 / sqrt(DIM).  Four times that is
#: asked of a text with enough distinct trigrams; a shorter one can be of a known language and stay below.
LEAST_LANGUAGE_SCORE = 4 / language_id.DIM ** 0.5
ENOUGH_TRIGRAMS = 40


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the labelled documents teach.  Rejected: no letter (null and
    empty texts too), or close to none of the languages.  Where no row has a label, only texts without a letter are
    rejected.  Ids play no part; repeated rows stay."""
    profiles = language_id.learn(docs)
    if not profiles.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = language_id.predict(docs, profiles, whole_rows=True)
    foreign = (F.col("trigrams") >= ENOUGH_TRIGRAMS) & (F.col("score") < LEAST_LANGUAGE_SCORE)
    return rows.where((F.col("lang_pred") != "und") & ~foreign).select("row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id (a null id is larger than any).  Rows that
    repeat id and text are one; null and empty texts are in no group.  Rows that share an id but not their text are decided
    each on its own."""
    rows, key = keyed(docs)
    of = jaccard_join.join(rows, id_col=key).where("n_shingles > 0").select(F.col("doc_id").alias(key), F.col("component_id").alias("group"))
    member = written(of.distinct().join(rows.select(key, "doc_id").distinct(), key), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", key))
    stays = written(member.groupBy("group").agg(first.alias("first")).select("group", F.col(f"first.{key}").alias("stays")), "stays")
    gone = member.join(stays, "group").where(F.col(key) != F.col("stays")).select(key)
    kept = without_ids(rows, gone, key)
    again = written(kept.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated_rows")
    return without_ids(kept, again, key).unionAll(kept.join(again, key, "left_semi").select(*kept.columns).dropDuplicates([key])).drop(key)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that stand elsewhere too; what loses all its words goes.  Null and
    empty texts stay as they are; rows without an id are documents as others are."""
    rows, key = keyed(docs)
    out = suffix_levels.dedup(rows, id_col=key, as_text=True)
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text")).alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")
    return (out.where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
            .select(*[changed.get(c, F.col(f"row.`{c}`")) for c in docs.columns]))


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.  A leaking row goes alone, whatever other rows share its id; null and empty
    texts stay."""
    rows, key = keyed(docs)
    found = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key, short_items=True)
    return without_ids(rows, found.select("doc_id"), key).drop(key)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, sources mixed to the square root of their mass, with the number of each copy.  A null or empty text
    counts as one character, a null source is a source, and rows that share an id are drawn alike."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", mixture),
]

#: Language vectors and fingerprints have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, step) in enumerate(STAGES):
        docs = written(step(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
