"""Work-type tags: response parsing, normalisation, totals, weekly series
(G1-G4, J1-J2, A7-A10, S13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import REPO
from ..functions.text import has_text, is_code_file
from ..functions.time import iso_week, since, week_start

# The default tag list, in the order the dimension ids follow.
DEFAULT_TAGS = ("Infrastructure, Database, Frontend, API, Backend, Security, Performance, "
                "Bug_Fix, Refactoring, Documentation, Testing, DevOps, Configuration, "
                "UX_Layout_CSS, Dependency_Update, Feature_Addition, Localization, "
                "Authentication, User_Account")
# Fixed value: tags shown before the rest is folded into "Other".
TOP_TAGS = 11


def tags_dim(names: str, repos: DataFrame,
             existing: DataFrame | None = None) -> DataFrame:
    """Tag dimension from a comma list (S13): trimmed names, ids in list
    order, insert-or-ignore against ``existing`` (new names get ids after
    the existing maximum)."""
    items = [n.strip() for n in names.split(",") if n.strip()]
    seen, ordered = set(), []
    for n in items:
        if n not in seen:
            seen.add(n)
            ordered.append(n)
    entries = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(n).alias("name"))
                        for i, n in enumerate(ordered)])
    new = repos.select(*REPO).distinct().select(*REPO, F.inline(entries))
    if existing is None:
        return new.select(*REPO, F.col("pos").alias("tag_id"), "name")
    fresh = new.join(existing.select(*REPO, "name"), [*REPO, "name"], "left_anti")
    top = existing.groupBy(*REPO).agg(F.max("tag_id").alias("_m"))
    w = Window.partitionBy(*REPO).orderBy("pos")
    fresh = (fresh.join(top, list(REPO), "left")
             .select(*REPO, (F.coalesce("_m", F.lit(0)) + F.row_number().over(w)).cast("int")
                     .alias("tag_id"), "name"))
    return existing.select(*REPO, "tag_id", "name").unionByName(fresh)


def parse_tags(responses: DataFrame, tags: DataFrame, key: list[str],
               text: str = "response") -> DataFrame:
    """Parse ``Name,weight,Name,weight...`` answers (G1).

    Pairs are walked two cells at a time; names are trimmed; a weight that is
    not an integer skips its pair; names outside the repository's tag list
    are dropped; a repeated name keeps its last weight.
    Output: key..., tag, weight (int).

    The whole answers are dealt by their key, so that a task's pairs follow
    the shuffle's partitions and not the files; the dimension is broadcast,
    as a join by name would put all pairs of a tag into one task.
    """
    cells = (responses.select(*REPO, *key, F.col(text).alias("_text")).repartition(*REPO, *key)
             .select(*REPO, *key, F.split(F.trim("_text"), ",").alias("_c")))
    pairs = cells.select(*REPO, *key, "_c",
                         F.posexplode("_c").alias("_pos", "_name")) \
        .filter(F.col("_pos") % 2 == 0)
    pairs = pairs.select(
        *REPO, *key, "_pos", F.trim("_name").alias("tag"),
        F.trim(F.get("_c", F.col("_pos") + 1)).try_cast("int").alias("weight"))
    pairs = pairs.filter(F.col("weight").isNotNull())
    known = pairs.join(F.broadcast(tags.select(*REPO, F.col("name").alias("tag"))),
                       [*REPO, "tag"], "left_semi")
    return (known.groupBy(*REPO, *key, "tag")
            .agg(F.max_by("weight", "_pos").alias("weight")))


def normalise(weights: DataFrame, key: list[str], weight: str = "weight") -> DataFrame:
    """weight / sum of weights per ``key`` (G2); a zero total gives no rows.

    The window is per answer (one change), bounded by the tag list size.
    """
    w = Window.partitionBy(*REPO, *key)
    total = F.sum(F.col(weight)).over(w)
    return (weights.withColumn("_t", total).filter(F.col("_t") != 0)
            .withColumn("value", F.col(weight).cast("double") / F.col("_t").cast("double"))
            .drop("_t"))


def commit_tags(shares: DataFrame, tags: DataFrame, key: list[str],
                existing: DataFrame | None = None) -> DataFrame:
    """Tag rows with dimension ids (G3); rows already present are skipped."""
    rows = shares.join(tags.select(*REPO, "tag_id", F.col("name").alias("tag")),
                       [*REPO, "tag"]).select(*REPO, *key, "tag_id", "value")
    if existing is not None:
        rows = rows.join(existing.select(*REPO, *key, "tag_id"), [*REPO, *key, "tag_id"], "left_anti")
    return rows


def untagged(changes: DataFrame, ctags: DataFrame, key: list[str]) -> DataFrame:
    """Described code-file changes without tag rows yet."""
    return (changes.filter(has_text("description") & is_code_file("filename"))
            .join(ctags.select(*REPO, *key).distinct(), [*REPO, *key], "left_anti"))


def with_tag_names(ctags: DataFrame, tags: DataFrame) -> DataFrame:
    """commit_tags joined to tag names (J1); the dimension is broadcast after
    a size check."""
    return ctags.join(tags.select(*REPO, "tag_id", "name"), [*REPO, "tag_id"])


def tagged_changes(ctags: DataFrame, tags: DataFrame, changes: DataFrame,
                   key: list[str], cols=("committed_at",)) -> DataFrame:
    """J1 joined to the changes they tag."""
    return with_tag_names(ctags, tags).join(
        changes.select(*REPO, *key, *cols), [*REPO, *key])


def dec_sum(c: str) -> Column:
    """Sum of shares as exact decimals: independent of summation order.  A
    share of a zero total (NaN or infinite) adds nothing (D11)."""
    share = F.when(F.abs(c) < F.lit(float("inf")), F.col(c)).when(F.col(c).isNotNull(), F.lit(0.0))
    return F.sum(share.cast("decimal(18,9)"))


def _r2(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def tag_totals(ctags: DataFrame, tags: DataFrame, changes: DataFrame | None = None,
               key: list[str] | None = None, since_mdy: str | None = None,
               include_all: bool = True, n: int = TOP_TAGS) -> DataFrame:
    """Sum of shares per tag, rounded to 2 (A7); with ``include_all=False``
    and more than ``n`` tags, the first ``n`` by total plus ``Other`` holding
    the sum of the rest's rounded totals (A8, D15)."""
    if since_mdy:
        rows = since(tagged_changes(ctags, tags, changes, key), since_mdy)
    else:
        rows = with_tag_names(ctags, tags)
    tot = rows.groupBy(*REPO, "name").agg(_r2(dec_sum("value")).alias("total_value"))
    if include_all:
        return tot
    w = Window.partitionBy(*REPO).orderBy(F.desc("total_value"), F.asc("name"))
    ranked = tot.withColumn("_rn", F.row_number().over(w)) \
        .withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*REPO)))
    return (ranked.groupBy(*REPO, F.when((F.col("_k") <= n) | (F.col("_rn") <= n), F.col("name"))
                           .otherwise(F.lit("Other")).alias("name"))
            .agg(F.sum("total_value").cast("decimal(18,2)").alias("total_value")))


def tags_by_week(ctags: DataFrame, tags: DataFrame, changes: DataFrame, key: list[str],
                 since_mdy: str | None = None, as_of: str | None = None) -> DataFrame:
    """Per ISO week and tag: sum of shares rounded to 2 (A9).  Every week
    from the first (or ``since``) through ``as_of`` is present; a week
    without tags has one row with NULL tag and total (T5, D8).

    One pass over the joined rows: the weekly table, one row per week and
    tag, knows its repository's first and last week by a window, its first
    row brings in the Monday spine, and each week then lists its tags.
    """
    rows = since(tagged_changes(ctags, tags, changes, key), since_mdy)
    weekly = (rows.groupBy(*REPO, week_start("committed_at").alias("week_starting"), "name")
              .agg(_r2(dec_sum("value")).alias("total")))
    w = Window.partitionBy(*REPO)
    mine = F.struct("week_starting", "name")
    weekly = (weekly.withColumn("_lo", F.min("week_starting").over(w)).withColumn("_hi", F.max("week_starting").over(w))
              .withColumn("_first", F.min(mine).over(w) == mine))
    lo = week_start(F.to_date(F.to_timestamp(F.lit(since_mdy), "MM/dd/yyyy"))) if since_mdy else F.col("_lo")
    hi = week_start(F.to_date(F.lit(as_of))) if as_of else F.col("_hi")
    own = F.array(F.struct("week_starting", "name", "total"))
    empty = [F.lit(None).cast("string").alias("name"), F.lit(None).cast("decimal(18,2)").alias("total")]
    spine = F.transform(F.sequence(lo, hi, F.expr("interval 7 days")), lambda x: F.struct(x.alias("week_starting"), *empty))
    entries = F.when(F.col("_first"), F.concat(own, spine)).otherwise(own)
    # a week's list is bounded by the tags; without any it gives one row of NULLs
    listed = (weekly.select(*REPO, F.inline(entries)).groupBy(*REPO, "week_starting")
              .agg(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "total"))).alias("_tags")))
    if as_of:
        listed = listed.filter(F.col("week_starting") <= hi)
    return (listed.select(*REPO, "week_starting", F.inline_outer("_tags").alias("tag", "total"))
            .select(*REPO, iso_week("week_starting").alias("week"), "week_starting", "tag", "total"))


def tag_share_by_week(ctags: DataFrame, tags: DataFrame, changes: DataFrame,
                      key: list[str]) -> DataFrame:
    """Per ISO week and tag: raw sum and percentage of the week's sum, both
    rounded to 2 (A10).  A zero week total gives 0 % (D11)."""
    rows = tagged_changes(ctags, tags, changes, key) \
        .withColumn("week_starting", week_start("committed_at"))
    weekly = rows.groupBy(*REPO, "week_starting", "name").agg(dec_sum("value").alias("_s"))
    # the week's total: a window over that week's tags (bounded by the tag list)
    weekly = weekly.withColumn("_w", F.sum("_s").over(Window.partitionBy(*REPO, "week_starting")))
    pct = F.when(F.col("_w") == 0, F.lit(0.0)).otherwise(
        F.col("_s").cast("double") * 100 / F.col("_w").cast("double"))
    return (weekly
            .select(*REPO, iso_week("week_starting").alias("week"), "week_starting",
                    F.col("name").alias("tag"), _r2(F.col("_s")).alias("raw"),
                    _r2(pct.cast("decimal(18,6)")).alias("percentage")))


def tag_share_matrix(ctags: DataFrame, tags: DataFrame, changes: DataFrame,
                     key: list[str], as_of: str | None = None) -> DataFrame:
    """Per tag, the weekly percentages over the whole week spine (0 where the
    tag is absent), ordered by week (A10).  Arrays are as long as the
    spine, i.e. bounded by the time span, not by the rows."""
    w = Window.partitionBy(*REPO)
    share = (tag_share_by_week(ctags, tags, changes, key)
             .withColumn("_lo", F.min("week_starting").over(w)).withColumn("_hi", F.max("week_starting").over(w)))
    per_tag = (share.groupBy(*REPO, "tag")
               .agg(F.map_from_entries(F.collect_list(F.struct("week_starting", "percentage"))).alias("_m"),
                    F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))
    hi = week_start(F.to_date(F.lit(as_of))) if as_of else F.col("_hi")
    zero = F.lit(0).cast("decimal(18,2)")
    return per_tag.select(*REPO, "tag", F.transform(
        F.sequence("_lo", hi, F.expr("interval 7 days")), lambda x: F.coalesce(F.try_element_at("_m", x), zero))
        .alias("weekly_percentage"))
