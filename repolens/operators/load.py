"""Incremental load: insert-if-absent, update by key, backfill from a log,
latest record per key, save-if-new (U1-U8, J5, O3, O4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import REPO


def first_per_key(batch: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in ``order`` (ties keep the smallest
    ``order`` tuple).  An aggregate with ``min_by`` -- it combines map-side,
    so a key repeated across a third of the batch is reduced in every task
    before the shuffle."""
    return _one_per_key(F.min_by, batch, keys, order)


def last_per_key(batch: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key in ``order`` (O4): ``max_by`` aggregate."""
    return _one_per_key(F.max_by, batch, keys, order)


def _one_per_key(pick, batch: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    # the keys come from the grouping, not out of the picked row: so they are
    # shuffled once, and a join by them finds the rows partitioned already
    others = [c for c in batch.columns if c not in keys]
    ordk = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = batch.groupBy(*keys).agg(pick(F.struct(*others) if others else F.lit(True), ordk).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in batch.columns])


def insert_new_near(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str | Column],
                    near: list[str]) -> DataFrame:
    """``insert_new`` for a large batch: batch and target meet in one shuffle
    by ``near``, some of the keys.  Rows that are equal there and lie together
    travel together, in a fraction of the bytes.  No combining before the
    shuffle: a value of ``near`` that holds much of the batch is left to
    ``insert_new``."""
    # a key with a null equals no other in a join
    held = target.select(*keys).dropna(subset=keys).withColumn("_held", F.lit(True))
    both = batch.withColumn("_held", F.lit(False)).unionByName(held, allowMissingColumns=True).repartition(*near)
    # the target's row of a key comes first
    first = Window.partitionBy(*keys).orderBy(F.desc("_held"), *order)
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1 and not _held").select(*batch.columns)


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str],
               order: list[str | Column]) -> DataFrame:
    """Rows of ``batch`` to append to ``target`` under a unique ``keys``
    constraint (U1, U2): the first row per key in input ``order`` wins, keys
    already in the target are skipped.  ``batch.count() - result.count()`` is
    the number skipped."""
    first = first_per_key(batch, keys, order)
    # A semi join with the batch's keys keeps the target rows that collide,
    # and the anti join runs against those.  The join strategy is left to
    # AQE, which broadcasts the batch by its measured size.
    bkeys = first.select(*keys)
    hits = target.select(*keys).join(bkeys, keys, "left_semi")
    return first.join(hits, keys, "left_anti")


def insert_counted(target: DataFrame, batch: DataFrame, keys: list[str],
                   order: list[str | Column], by_range: bool = False) -> tuple[DataFrame, DataFrame]:
    """``insert_new`` with its report (U1): (rows to append, counts per
    repository: ``read``, ``inserted``, ``skipped``).  The batch is computed
    once, for the rows and for the report: batch and target's keys meet in
    one shuffle, and what is kept of a skipped row is its repository.

    ``by_range``, for a large batch of few rows a key: the shuffle goes by
    ranges of the keys, so that rows with the same first keys travel together,
    in a fraction of the bytes.  It doesn't combine the rows of a key before
    the shuffle."""
    from ..session import cut_lineage
    others = [c for c in batch.columns if c not in keys]
    ordk = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    read = batch.select(*keys, (F.struct(*others) if others else F.lit(True)).alias("_r"), ordk.alias("_o"))
    # a key with a null equals no other in a join
    held = target.select(*keys).dropna(subset=keys)
    both = read.unionByName(held, allowMissingColumns=True)
    if by_range:
        both = both.repartitionByRange(*keys)
    # the target's rows have no place in the order, so none of them is picked
    met = both.groupBy(*keys).agg(F.min_by("_r", "_o").alias("_r"), F.count("_o").alias("_n"),
                                  F.count(F.when(F.col("_o").isNull(), 1)).alias("_held")).filter("_n > 0")
    new = F.col("_held") == 0
    # a batch row counts once for each target row of its key
    kept = cut_lineage(met.select(
        *[F.col(c) if c in REPO else F.when(new, F.col(c)).alias(c) for c in keys], F.when(new, F.col("_r")).alias("_r"),
        (F.col("_n") * F.greatest("_held", F.lit(1))).alias("_n"), new.alias("_new")))
    counts = kept.groupBy(*REPO).agg(F.sum("_n").alias("read"), F.count(F.when(F.col("_new"), 1)).alias("inserted"))
    out = [(F.col(f.name) if f.name in keys else F.col(f"_r.{f.name}")).cast(f.dataType).alias(f.name) for f in batch.schema.fields]
    return (kept.filter("_new").select(*out),
            counts.withColumn("skipped", F.col("read") - F.col("inserted")))


def todo(left: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a match in ``done``."""
    return left.join(done.select(*keys), keys, "left_anti")


def update_by_key(target: DataFrame, updates: DataFrame, keys: list[str],
                  cols: list[str]) -> DataFrame:
    """Target with ``cols`` replaced where ``updates`` has the key.
    ``updates`` must hold one row per key (see ``last_per_key``)."""
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in cols],
                       F.lit(True).alias("_u_hit"))
    j = target.join(u, keys, "left")
    out = [F.when(F.col("_u_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)
           if c in cols else F.col(c) for c in target.columns]
    return j.select(*out)


def not_found(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Update rows whose key is not in the target (U3 report)."""
    return updates.join(target.select(*keys), keys, "left_anti")


def backfill_descriptions(changes: DataFrame, log: DataFrame, enabled: bool = True) -> DataFrame:
    """Fill NULL descriptions from the description log (U5, U8, D2): the
    latest text per (file, commit) by log time, the earlier append and line
    first on equal times; rows that already have a description are kept."""
    if not enabled:
        return changes
    if "appended_at" not in log.columns:      # a log of one append
        log = log.withColumn("appended_at", F.lit(0).cast("bigint"))
    latest = last_per_key(
        log.select(*REPO, "filename", "commit_hash", "logged_at", "appended_at", "position", "text"),
        [*REPO, "filename", "commit_hash"], ["logged_at", -F.col("appended_at"), -F.col("position")])
    lt = latest.select(*REPO, "filename", "commit_hash", F.col("text").alias("_log"))
    # only the rows without a description are shuffled to the log
    j = changes.filter("description is null").join(lt, [*REPO, "filename", "commit_hash"], "left")
    return changes.filter("description is not null").unionByName(
        j.select(*[F.col("_log").alias(c) if c == "description" else F.col(c) for c in changes.columns]))


def latest_summary(summaries: DataFrame, name: str | None = None) -> DataFrame:
    """Most recent summary per (repo, name) (O3, L11, D12: none -> no row)."""
    s = summaries if name is None else summaries.filter(F.col("name") == name)
    return last_per_key(s, [*REPO, "name"], ["created_at", "hash"])


def summary_for_display(summaries: DataFrame, name: str | None = None) -> DataFrame:
    """Latest summary per (repo, name) with ``yyyy/MM/dd`` dates."""
    from ..functions.time import display_date
    return latest_summary(summaries, name).select(
        *REPO, "name", "summary", "ai_service", "ai_model",
        display_date("start_date").alias("start"), display_date("end_date").alias("end"))


def data_fingerprint(df: DataFrame, by: list[str] = list(REPO)) -> DataFrame:
    """Order-insensitive content key of a data set per repository (U6): that
    of its rows as JSON (``lines_fingerprint``)."""
    others = [c for c in df.columns if c not in by]
    return lines_fingerprint(df.select(*by, F.to_json(F.struct(*others)).alias("_line")), by, "_line")


def lines_fingerprint(lines: DataFrame, by: list[str], line: str) -> DataFrame:
    """Two exact sums of 64-bit hashes of every line plus the line count:
    sums, unlike XOR, tell repeated lines apart, and partial aggregation never
    builds the data set's whole text in one place."""
    wide = [F.sum(F.xxhash64(F.col(line), F.lit(i)).cast("decimal(38,0)")).cast("string").alias(f"_h{i}") for i in (1, 2)]
    return (lines.groupBy(*by).agg(*wide, F.count(F.lit(1)).alias("rows"))
            .select(*by, F.concat_ws("-", F.md5(F.concat_ws(",", "_h1", "_h2")), "rows").alias("hash"), "rows"))


def save_summary_if_new(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate summaries whose (repo, name, hash) is not stored yet."""
    return candidates.join(existing.select(*REPO, "name", "hash"), [*REPO, "name", "hash"],
                           "left_anti")
