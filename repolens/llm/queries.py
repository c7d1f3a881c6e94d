"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixing
from .common import documents, held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level BPE."""
    import public_tokenizers
    from .token_counts import token_counts
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of four fifths of the ids."""
    from . import quality
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return quality.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labels of three quarters of the ids."""
    from . import language_id
    docs = documents(spark, sf_dir)
    profiles = language_id.learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return language_id.predict(docs, profiles).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by inner product of every vector whose id is divisible by 100."""
    from .topk import top_k
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLES["op5_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score
  from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 10
"""


@query
def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted into windows and read back."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionAll(extra)
    return chat.digests(chat.windows(turns))


ORACLES["op6_chat_windows"] = chat.ORACLE_SQL


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources mixed to the square root of their mass."""
    return mixing.mix(documents(spark, sf_dir))


ORACLES["op3_mix_sources"] = mixing.oracle_sql()


@query
def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all documents that repeat a benchmark item."""
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word windows that a smaller document has too."""
    from . import substring_dedup
    out = substring_dedup.dedup(documents(spark, sf_dir))
    return out.select("row.doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that also start elsewhere."""
    from . import suffix_levels
    out = suffix_levels.dedup(documents(spark, sf_dir))
    return out.select("row.doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from . import jaccard_join
    return jaccard_join.join(documents(spark, sf_dir))


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents, and which row of them stays."""
    from . import exact_dedup
    return exact_dedup.mark(documents(spark, sf_dir))


ORACLES["op13_exact_dedup"] = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; ids divisible by 7 carry a wrong label."""
    from . import hard_negatives
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, cast(list_inner_product(a.e, v.e) as bigint) as score
  from v as a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
  cast(row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as int) as rank,
  s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id)
where not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
qualify rank <= 5
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item."""
    from . import lexical_search
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_lexical_search"] = r"""
with t as (
  select 0 as kind, doc_id as id, row_number() over () as r, text from documents
  union all select 1, item_id, row_number() over (), text from benchmark
), w as (
  select kind, id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from t where text is not null
), tf as (
  select id as doc_id, r, term, count(*) as tf from w where kind = 0 group by all
), len as (
  select r, sum(tf)::bigint as n from tf group by r
), total as (
  select count(*) as n_docs, sum(n)::bigint as n_terms from len
), idf as (
  select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, total group by term, n_docs
), item as (
  select distinct id as item_id, term from w where kind = 1 and id is not null
), s as (
  select item_id, doc_id, r, sum(idf.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::bigint as score
  from item join idf using (term) join tf using (term) join len using (r), total group by all
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from s where score > 0 qualify rank <= 10
"""
