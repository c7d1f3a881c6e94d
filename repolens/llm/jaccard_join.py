"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence with its transpose.

Documents with equal shingle sets are one class and one row of the matrix.  All links of similarity 0.8 or more between
classes are found; copies and links within a cluster are never written out pair by pair.

1. Sizes.  A scan gives each document its set's size and fingerprint, and the shingles that repeat inside a block of
   documents; summed, they tell the commonest shingles (the ``FREQUENT`` first, a bounded list).
2. Columns.  Shingles are ordered rare first (the listed ones by count, then by fingerprint).  Two sets that overlap enough
   share one of the first n - ceil(0.8 n) + 1 shingles of each, so only those entries of the matrix travel, by shingle.
3. Partial products.  In a column of up to ``SHORT`` classes the pairs are counted.  A pair whose common entries plus all
   that could still follow stay below the overlap that its sizes call for is discarded.  In a longer column, every class
   is tied to the column's first one, without a pair being made or discarded.
4. Blocks.  What hangs together goes into row blocks of ``BLOCK`` bytes; each pair of blocks is multiplied out on the full
   sets, which gives exact overlaps, and returns the links as a forest of at most one link per class.
5. Components of the links.

The order and the list only steer how much work is done; any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import bytescan
from .common import arrow_schema, components, discard, scan, written

N = 5
PERCENT = 80
GATHER = 2 << 20  # shingles of a block whose repeats are counted together
FREQUENT = 1 << 19
SHORT = 128
BLOCK = 2 << 20
DENSE = 8  # columns of more entries are multiplied as dense matrices

_PROFILE = "doc_id long, n int, cls long, shingle long, times long"


def _word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(off) == 2 and off[-1] > 2 * bytescan.PIECE:
        h = np.concatenate([_word_hashes(data[a:b], np.array([0, b - a]))[0] for a, b in bytescan.cuts(data, 0, int(off[-1]))])
        return h, np.array([0, len(h)])
    data = bytescan.LOWER[data]
    starts, ends, first = bytescan.words(data, off)
    return bytescan.span_hashes(data, starts, ends), first


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle fingerprints of each text."""
    data, off = bytescan.flat(column)
    for a, b in bytescan.pieces(off):
        h, first = _word_hashes(data[off[a]:off[b]], off[a:b + 1] - off[a])
        runs = bytescan.ladder(h, N)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            if j - i >= N:
                yield np.unique(runs[i:j - N + 1])
            elif j > i:
                x = np.array([j - i], np.uint64)
                for w in h[i:j]:
                    x = bytescan.join(x, np.array([w]))
                yield x
            else:
                yield h[:0]


def _cls(x: np.ndarray) -> int:
    return int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, gathered, size = arrow_schema(_PROFILE), [], 0

    def repeated() -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(gathered), return_counts=True)
        u, c = u[c > 1], c[c > 1]
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.nulls(len(u), pa.int32()), none, pa.array(u.view(np.int64)), pa.array(c)], schema=schema)

    for batch in batches:
        n, cls = [], []
        for x in _sets(batch.column(1)):
            n.append(len(x))
            cls.append(_cls(x) if len(x) else None)
            gathered.append(x)
            size += len(x)
            if size > GATHER:
                yield repeated()
                gathered, size = [], 0
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), none, none], schema=schema)
    if size:
        yield repeated()


def _prefix(n):
    return n - -(-PERCENT * n // 100) + 1


def _entries(frequent: np.ndarray, times: np.ndarray):
    """(key, cls, n): the entries of the first columns of each class, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seen = arrow_schema("key long, cls long, n int"), set()
        for batch in batches:
            keys, cls, sizes = [], [], []
            for x in _sets(batch.column(0)):
                if not len(x) or (c := _cls(x)) in seen:
                    continue
                seen.add(c)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    x = x[np.argsort(np.where(frequent[at] == x, times[at], 0), kind="stable")]
                keys.append(x[:_prefix(len(x))])
                cls.append(c)
                sizes.append(len(x))
            if keys:
                many = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(cls, np.int64), many)),
                                                  pa.array(np.repeat(np.array(sizes, np.int32), many))], schema=schema)
    return run


def _linked(overlap, a, b):
    return 100 * overlap >= PERCENT * (a + b - overlap)


def _overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two blocks of sets, one column chunk of the product after the other."""
    out = np.zeros((len(rows), len(cols)), np.int64)
    if len(rows) * len(cols) <= 4:
        for i, x in enumerate(rows):
            for j, y in enumerate(cols):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    value = np.concatenate([*rows, *cols])
    owner = np.repeat(np.arange(len(rows) + len(cols)), [len(x) for x in (*rows, *cols)])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.concatenate([start, [len(value)]]))
    each = np.repeat(count, count)
    # Columns of few entries: the pairs one, two, ... places apart.
    v, o = value[(each > 1) & (each <= DENSE)], owner[(each > 1) & (each <= DENSE)]
    for d in range(1, DENSE):
        hit = (v[d:] == v[:-d]) & (o[:-d] < len(rows)) & (o[d:] >= len(rows)) if len(v) > d else np.zeros(0, bool)
        if hit.any():
            out += np.bincount(o[:-d][hit] * len(cols) + o[d:][hit] - len(rows), minlength=out.size).reshape(out.shape)
    # The others: dense chunks.
    many = each > DENSE
    column = np.cumsum(np.concatenate([[False], value[many][1:] != value[many][:-1]])) if many.any() else np.zeros(0, int)
    o = owner[many]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, [a, a + 2048])
        m = np.zeros((len(rows) + len(cols), 2048), np.float32)
        m[o[i:j], column[i:j] - a] = 1
        out += np.rint(m[:len(rows)] @ m[len(rows):].T).astype(np.int64)
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Places of links that suffice to tie together what all links (a, b) tie together."""
    parent, keep = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep.append(k)
    return keep


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, i, j, block, cls, set), sorted: the links between blocks i and j, or inside block i if i = j."""
    schema, out = arrow_schema("a long, b long"), []
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for (_, i, j), group in groupby(rows, itemgetter(0, 1, 2)):
        members = [(block, cls, np.frombuffer(x, np.uint64)) for _, _, _, block, cls, x in group]
        left = [m for m in members if m[0] == i]
        right = left if i == j else [m for m in members if m[0] == j]
        if not left or not right or (i == j and len(left) < 2):
            continue
        common = _overlaps([m[2] for m in left], [m[2] for m in right])
        na, nb = np.array([len(m[2]) for m in left])[:, None], np.array([len(m[2]) for m in right])[None, :]
        x, y = np.nonzero(_linked(common, na, nb))
        if i == j:
            x, y = x[x < y], y[x < y]
        base = 0 if i == j else len(left)
        for k in _forest(x, y + base, len(left) + len(right)):
            out.append((left[x[k]][1], right[y[k]][1]))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        sets = [(c, x.tobytes()) for c, x in zip(wanted, _sets(batch.column(0))) if len(x) and _cls(x) == c]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())],
                                         schema=arrow_schema("cls long, set binary"))


def _need(a: Column, b: Column) -> Column:
    """The least overlap that links sets of these sizes."""
    return F.ceil(F.lit(PERCENT) * (a + b) / F.lit(100 + PERCENT))


def _rest(n: Column) -> Column:
    return F.ceil(F.lit(PERCENT) * n / F.lit(100)) - 1


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id that links lead to, its own included.

    Words are what stands between blanks, A-Z in lower case; a set holds the distinct runs of five words, or the whole
    sequence of a shorter text.  Two rows link when 100 * |both| >= 80 * |either|.  Null and empty texts have no set and
    are linked with nothing.  Rows that repeat an id are rows each; a null id is never a component's smallest, and a
    component of such rows alone is null.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = written(scan(rows, _profile, _PROFILE), "shingle_profile")
    sizes = profile.where("n is not null").select("doc_id", "n", "cls")
    # A bounded list comes to the driver, 16 bytes an entry.
    common = (profile.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
              .orderBy(F.desc("times"), "shingle").limit(FREQUENT).toArrow())
    frequent, times = common["shingle"].to_numpy().view(np.uint64), common["times"].to_numpy()
    order = np.argsort(frequent)
    entries = scan(rows.select("text"), _entries(frequent[order], times[order]), "key long, cls long, n int")

    # The columns.  The window streams; a column of many classes is never held in memory.
    key = Window.partitionBy("key")
    columns = (entries.repartition("key").groupBy("key", "cls").agg(F.first("n").alias("n"))
               .select("key", "cls", "n", F.count("*").over(key).alias("height"), F.min("cls").over(key).alias("top")).where("height > 1"))
    columns = written(columns, "columns")
    short = columns.where(F.col("height") <= SHORT).select("key", "cls", "n")
    x, y = short.select("key", F.col("cls").alias("a"), F.col("n").alias("na")), short.select("key", F.col("cls").alias("b"), F.col("n").alias("nb"))
    size_ok = (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    counted = x.join(y, "key").where((F.col("a") < F.col("b")) & size_ok).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    kept = counted.where(F.col("both") + F.greatest(_rest(F.col("na")), _rest(F.col("nb"))) >= _need(F.col("na"), F.col("nb"))).select("a", "b")
    tied = columns.where((F.col("height") > SHORT) & (F.col("cls") != F.col("top"))).select(F.col("top").alias("a"), F.col("cls").alias("b")).distinct()
    groups = written(components(kept.unionAll(tied)), "candidate_groups")
    discard(docs.sparkSession, columns)

    # The full sets of the classes that are left, from one document each.
    classes = sizes.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"))
    # The document whose text is read: any row of the class will do, also one without an id.
    source = sizes.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"))).alias("r"))
    wanted = groups.join(source, F.col("node") == F.col("cls")).select("cls", "r.id", "root")
    sets = (rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "cls"))
    sets = written(scan(sets, _full_sets, "cls long, set binary").dropDuplicates(["cls"]), "sets")
    member = sets.join(groups.select(F.col("node").alias("cls"), F.col("root").alias("group")), "cls")
    per_group = member.groupBy("group").agg(F.ceil(F.sum(F.length("set") + 64) / BLOCK).cast("int").alias("blocks"))
    member = member.join(per_group, "group").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = (member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "set")
             .repartition("group", "i", "j").sortWithinPartitions("group", "i", "j"))
    links = written(scan(dealt, _products, "a long, b long"), "links")
    discard(docs.sparkSession, sets)

    roots = components(links)
    of_class = classes.select("cls", "first").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    least = of_class.groupBy("root").agg(F.min("first").alias("component_id"))
    final = of_class.join(least, "root").select("cls", "component_id")
    # A class of a third of all rows is one key here: the small side is copied to the parts of a split partition.
    out = sizes.join(final, "cls", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
