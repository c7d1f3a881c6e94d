"""Benchmark decontamination, with DataFrame functions only.

Words are runs of letters and digits, in lower case; shingles are five words.  An item of m words is compared with document
windows of m words.

1. Windows: every window of an item's length that holds a shingle of an item of that length, wherever in the item it stands.
   A window with c such shingles has at most similarity c / (shingles of window and item - c), and one that this keeps below
   the threshold is left out, so nothing similar is missed, be its parts moved or not.
2. SimHash: every window and item gets 64 bits, each the sign of the sum of its shingles' hash bits, repeats counted.
3. Multi-index: the 64 bits fall into RADIUS + 1 blocks.  Two fingerprints at most RADIUS bits apart agree on a block at
   least, so equal (length, block, bits) find all of them; the rest of the bits then decides.
4. The pairs that are left are verified: similarity is the sum of the smaller over the sum of the larger shingle counts.

RADIUS is wide enough for the SimHash distance of windows at the threshold (64 bits at similarity 0.8 differ in 9.7 on
average, with a deviation of 2.9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without_ids

SHINGLE = 5
RADIUS = 18
SIMILARITY = 0.8
#: Benchmark shingles up to this number are broadcast (about 64 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, width: int = SHINGLE) -> Column:
    """Hashes of the runs of ``width`` words, in order."""
    n = F.size(words)
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), at)).otherwise(F.array().cast("array<bigint>"))


def _simhash(shingles: Column) -> Column:
    half = F.size(shingles) / 2
    bit = lambda b: F.aggregate(shingles, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int")) > half
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
                       lambda s, b: F.when(bit(b), s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))).otherwise(s))
    return F.coalesce(bits, F.lit(0).cast("bigint"))  # never null, which Spark then need not test


def _blocks(bits: Column) -> Column:
    """(block, its bits) of a fingerprint, for RADIUS + 1 blocks."""
    edges = [i * 64 // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(bits, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits"))
                     for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def _numbered(s: Column) -> Column:
    """The shingles as a set: a repeat becomes a value of its own, made from the shingle and its number."""
    earlier = lambda h, i: F.size(F.filter(F.slice(s, F.lit(1), i), lambda y: y == h))
    number = lambda h, n: F.when(n == 0, h).otherwise(F.xxhash64(h, n))
    return F.when(F.size(F.array_distinct(s)) == F.size(s), s).otherwise(F.transform(s, lambda h, i: number(h, earlier(h, i))))


def _similarity(a: Column, b: Column) -> Column:
    """The smaller over the larger counts; null if neither has a shingle."""
    a, b = _numbered(a), _numbered(b)
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both, F.size(a) + F.size(b) - both)


def _windows(hits: DataFrame, similarity: float) -> DataFrame:
    """doc_id, m, start, n_words, s: the windows of m words with a hit (doc_id, n, s, pos, m), and hits enough for ``similarity``.

    Starts are dealt to blocks of m, and a block takes with it only the shingles that its windows cover, so a row is bounded by
    the item's length and not by the document's."""
    n, m, pos = F.col("n"), F.col("m"), F.col("pos")
    last = F.greatest(F.lit(0), n - m)  # the last start
    width = F.least(m, n) - (SHINGLE - 1)
    first, end = F.greatest(F.lit(0), pos - width + 1), F.least(pos, last)  # the starts that cover the hit
    block = lambda start: start - start % m
    hits = hits.withColumn("low", F.explode(F.array_distinct(F.array(block(first), block(end)))))
    segment = F.slice("s", F.col("low") + 1, m + width - 1)
    at = (hits.select("doc_id", "n", "m", "low", segment.alias("part"), "pos")
          .groupBy("doc_id", "n", "m", "low", "part").agg(F.collect_set("pos").alias("at")))
    count = lambda i: F.size(F.filter("at", lambda p: (p >= i) & (p < i + width)))
    both = width + m - (SHINGLE - 1)
    least = F.greatest(F.lit(1), F.ceil(F.lit(similarity) * both / F.lit(1 + similarity) - F.lit(1e-6)))
    starts = F.filter(F.sequence(F.col("low"), F.least(F.col("low") + m - 1, last)), lambda i: count(i) >= least)
    windows = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice("part", i - F.col("low") + 1, width).alias("s")))
    return at.select("doc_id", "m", F.least(m, n).alias("n_words"), F.inline(windows)).distinct()


def _short(docs: DataFrame, items: DataFrame, widths: list[int]) -> DataFrame:
    """Leaks of items of fewer words than a shingle has: windows of the very same words."""
    found = None
    for m in widths:
        own = items.where(F.size("w") == m).select("item_id", F.get(_shingles(F.col("w"), m), F.lit(0)).alias("h"))
        few = own.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        windows = docs.select("doc_id", F.posexplode_outer(_shingles(F.col("w"), m)).alias("start", "h"))
        hits = windows.join(F.broadcast(own) if few else own, "h").select(
            "doc_id", "item_id", "start", F.lit(m).alias("n_words"), F.lit(1.0).alias("similarity")).distinct()
        found = hits if found is None else found.unionAll(hits)
    return found


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", short_items: bool = False) -> DataFrame:
    """doc_id, item_id, start (word, from 0), n_words, similarity: the windows that repeat a benchmark item.

    An item's copy is found by several windows, those a few words beside it too.  In a document shorter than the item the
    window is the whole document.  An item of fewer than five words matches nothing, or with ``short_items`` the very same
    words in the same order.  Null and empty texts match nothing, and an empty table gives no rows.  Repeated rows of an id give their windows once; null
    ids are kept as null.  A very long text is cut into the blocks around its hits.  Other columns are not read.
    """
    items = items.select(F.col(item_col).cast("long").alias("item_id"), _words(F.col(item_text_col)).alias("w"))
    widths = [r["m"] for r in items.select(F.size("w").alias("m")).where(f"m between 1 and {SHINGLE - 1}").distinct().collect()] if short_items else []
    worded_items = items
    items = items.select("item_id", F.size("w").alias("m"), _shingles(F.col("w")).alias("item_s")).where(F.col("m") >= SHINGLE)
    places = items.select("m", F.explode_outer("item_s").alias("h")).distinct()
    few = places.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    small = F.broadcast if few else (lambda x: x)
    worded = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(F.col(text_col)).alias("w"))
    d = worded.select("doc_id", F.size("w").alias("n"), _shingles(F.col("w")).alias("s"))
    # The outer form: Spark would else infer filters that compute the arrays a second time.
    hits = d.select("doc_id", "n", "s", F.posexplode_outer("s").alias("pos", "h")).join(small(places), "h")
    w = _windows(hits, similarity).withColumn("f", _simhash(F.col("s")))
    items = items.withColumn("item_f", _simhash(F.col("item_s")))
    pairs = (w.withColumn("k", F.explode(_blocks(F.col("f")))).select("*", "k.block", "k.bits").drop("k")
             .join(small(items.withColumn("k", F.explode(_blocks(F.col("item_f")))).select("*", "k.block", "k.bits").drop("k")), ["m", "block", "bits"])
             .where(F.bit_count(F.col("f").bitwiseXOR(F.col("item_f"))) <= RADIUS))
    # By the shingles too: an id can stand on several texts.  Dealt by number, for verification costs time and few bytes.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (pairs.select("doc_id", "item_id", "start", "n_words", "s", "item_s").repartition(tasks, "doc_id", "item_id", "start").distinct())
    found = (found.withColumn("similarity", _similarity(F.col("s"), F.col("item_s"))).where(F.col("similarity") >= similarity)
             .select("doc_id", "item_id", "start", "n_words", "similarity").distinct())
    return found.unionAll(_short(worded, worded_items, widths)) if widths else found


def without_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id has no leak, all columns as they are."""
    return without_ids(docs, found.select("doc_id"), id_col)
