"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's repetition rate is its share of the mixture's mass over its own mass, so that the mixture keeps the mass of the
input.  Each document is drawn ``Poisson(rate)`` times: a hash of its id is a uniform number, and the count is the inverse
of the distribution function at that number.  A rate above ``PART`` is a sum of equal parts, each with its own hash.
Counts depend on nothing but the id, the seed and the rate: a lost task draws the same again.

Copies are dealt to partitions by a hash of id and copy number and sorted by it there: a global random order, without a
range sampling pass, and as even for a source with a third of all rows as for any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 32.0
#: One row per source, with its distribution function of some 1 KB; more sources than this are joined by a shuffle.
MOST_BROADCAST = 4096


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' md5."""
    return F.conv(F.substring(_hash(*parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, mass (characters, one at least per row), rate.

    ``weights`` gives target shares by source (they are scaled to 1; a source that it does not name gets none); without it
    a source's share goes with its mass to the power ``alpha``.  Null is a source of its own.
    """
    mass = (docs.groupBy(F.col(source_col).cast("string").alias("source"))
            .agg(F.sum(F.greatest(F.coalesce(F.length(F.col(text_col)), F.lit(0)), F.lit(1))).cast("double").alias("mass")))
    if weights is None:
        share = F.pow("mass", F.lit(float(alpha)))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        share = F.coalesce(F.element_at(table, F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0)
    mass = mass.withColumn("share", share)
    total = mass.agg(F.sum("mass").alias("m"), F.sum("share").alias("s")).first()
    scale = (total["m"] / total["s"]) if total["s"] else 0.0
    return mass.select("source", "mass", (F.lit(scale) * F.col("share") / F.col("mass")).alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, far into its tail."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.concat(s["all"], F.array(s["sum"] + p)).alias("all"))
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, seed: str = "mix", id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", copy_col: str = "copy") -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with the number of the copy (from 1) in ``copy_col``, in random order.

    Rows that share an id are drawn alike, and so are rows with a null id, as one id.  A null or empty text counts as one
    character.  A source of rate 0 goes; an empty table gives no rows.  All columns are kept; one that is called
    ``copy_col`` is replaced.
    """
    # The original row travels in one column, so that no name can clash.
    kept = [c for c in docs.columns if c.lower() != copy_col.lower()]
    who = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(source_col).cast("string").alias("source"), who.alias("who"))
    table = rates(docs, weights, alpha, source_col, text_col)
    parts = F.ceil(F.col("rate") / PART).cast("int")
    table = table.where("rate > 0").select(F.col("source").alias("of"), parts.alias("parts"), _distribution(F.col("rate") / parts).alias("sums"))
    few = table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    drawn = rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("of")))
    once = lambda i: F.size(F.filter("sums", lambda c: c <= uniform(F.lit(seed), F.col("who"), i.cast("string"))))
    count = F.when(F.col("parts") == 1, once(F.lit(1))).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda s, i: s + once(i)))
    drawn = drawn.withColumn("n", count).where("n > 0").select("row", "who", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("no"))
    place = _hash(F.lit(seed + "-order"), F.col("who"), F.col("no").cast("string"))
    return (drawn.withColumn("place", place).repartition("place").sortWithinPartitions("place")
            .select("row.*", F.col("no").alias(copy_col)))


def oracle_sql(alpha: float = 0.5, seed: str = "mix") -> str:
    """DuckDB's form of ``mix`` over documents, for rates of up to ``PART``."""
    return f"""
with m as (select source, cast(sum(greatest(coalesce(length(text), 0), 1)) as double) as mass from documents group by source),
w as (select source, mass, pow(mass, {alpha}) as share from m),
r as (select source, (select sum(mass) / sum(share) from w) * share / mass as rate from w),
k as (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 20) as int) + 1)) as k from r),
c as (select source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k) as p from k),
l as (select source, list(p order by k) as sums from c group by source),
d as (
  select documents.*, len(list_filter(sums, lambda p: p <= cast(('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(cast(doc_id as varchar), ''), '1')), 1, 13)) as bigint) / {float(1 << 52)})) as n
  from documents join l on documents.source is not distinct from l.source
)
select doc_id, text, lang, source, n_chars, cast(unnest(range(1, n + 1)) as int) as copy from d
"""
