"""Small plan-shaping helpers used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group ``by`` in ``order``.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so each task forwards at most n rows per group: a group
    holding a third of all rows never reaches one task whole.
    """
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= n).drop("_rn"))


def dec(c: Column | str, scale: int = 6, precision: int = 18) -> Column:
    """Exact decimal view of a double, for sums that must not depend on the
    summation order."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal({precision},{scale})")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to the session's shuffle partitions, a number that follows
    the data, before a CPU-heavy Python stage (parser, chunker): a few
    megabytes of source text would otherwise land in one task.  Hashing by
    ``keys`` keeps the assignment deterministic on retry."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)
