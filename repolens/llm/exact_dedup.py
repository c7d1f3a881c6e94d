"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Rows are numbered once, in a table bucketed by chunk: a chunk is up to 2 ** 16 rows of one input partition.
2. A chunk sorts the fingerprints of its texts, a few bits more than the row count needs, and sends each owner the ones of
   its range: the gaps between them, Golomb-Rice coded.  Equal texts of a chunk are sent once, however many there are.
3. An owner decodes its messages and answers each with a bitmap: the fingerprints that another chunk has sent too.
4. A chunk marks its suspects, the rows whose fingerprint stands in another chunk or twice in its own.  The marks go to the
   bucketed table; texts that are no suspects never leave their bucket.
5. The suspects' texts are compared byte by byte, by grouping on the text itself, copies of a task combined before the
   shuffle.  So a fingerprint that two texts share costs one comparison and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bucketed, discard, written

CHUNK_BITS = 16
OWNER_ROWS = 1 << 22  # fingerprints that an owner gets on average, at most
SPARE_BITS = 8  # of 2 ** SPARE_BITS rows about one is a suspect for its fingerprint alone

_MESSAGE = "chunk long, owner long, n int, rice int, quotients binary, rests binary"
_REPLY = "chunk long, owner long, hits binary"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def golomb(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """(rice, quotients, rests) of gaps >= 0: the quotients by 2 ** rice in unary, the rests in ``rice`` bits each."""
    rice = max(0, int(0.69 * float(gaps.mean()) + 1).bit_length() - 1) if len(gaps) else 0
    high = (gaps >> np.uint64(rice)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    shifts = np.arange(rice, dtype=np.uint64)
    rests = (gaps[:, None] >> shifts[None, :] & np.uint64(1)).astype(np.uint8)
    return rice, np.packbits(unary).tobytes(), np.packbits(rests).tobytes()


def gaps_of(n: int, rice: int, quotients: bytes, rests: bytes) -> np.ndarray:
    """The gaps that ``golomb`` has coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rests, np.uint8))[:n * rice].reshape(n, rice).astype(np.uint64)
    low = (bits << np.arange(rice, dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)
    return (high.astype(np.uint64) << np.uint64(rice)) + low


class _Exchange:
    """What chunks and owners agree on: the width of a fingerprint and the range of an owner."""

    def __init__(self, rows: int, least_owners: int):
        self.bits = min(63, max(rows, 1).bit_length() + SPARE_BITS)
        owners = max(least_owners, -(-rows // OWNER_ROWS))
        self.range_bits = max(0, self.bits - (owners - 1).bit_length())

    def prints(self, fp: pa.ChunkedArray) -> np.ndarray:
        return fp.to_numpy().view(np.uint64) >> np.uint64(64 - self.bits)

    def shares(self, sent: np.ndarray) -> list[tuple[int, int, int]]:
        """(owner, a, b): the sorted fingerprints [a, b) belong to the owner."""
        owner = sent >> np.uint64(self.range_bits)
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(sent) else np.zeros(0, np.int64)
        return [(int(owner[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(sent)])]

    def send(self, chunk: pa.Table) -> pa.Table:
        sent = np.unique(self.prints(chunk["fp"]))
        rows = []
        for owner, a, b in self.shares(sent):
            own = sent[a:b] - np.uint64(owner << self.range_bits)
            gaps = np.concatenate([own[:1], own[1:] - own[:-1] - np.uint64(1)])
            rows.append((chunk["chunk"][0].as_py(), owner, b - a, *golomb(gaps)))
        return _table(rows, _MESSAGE)

    def answer(self, messages: pa.Table) -> pa.Table:
        """The bitmaps of one owner; all fingerprints are of its range, so the range's start doesn't matter."""
        received = []
        for n, rice, quotients, rests in zip(*(messages[c].to_pylist() for c in ("n", "rice", "quotients", "rests"))):
            gaps = gaps_of(n, rice, quotients, rests)
            gaps[1:] += np.uint64(1)
            received.append(np.cumsum(gaps))
        size = [len(x) for x in received]
        _, back, times = np.unique(np.concatenate(received), return_inverse=True, return_counts=True)
        again = np.split(times[back] > 1, np.cumsum(size)[:-1])
        rows = [(c, o, np.packbits(x).tobytes()) for c, o, x in zip(messages["chunk"].to_pylist(), messages["owner"].to_pylist(), again) if x.any()]
        return _table(rows, _REPLY)

    def mark(self, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        """The chunk's suspects, a bit per row number."""
        if not chunk.num_rows:
            return _table([], "chunk long, bits array<long>")
        sent, back, times = np.unique(self.prints(chunk["fp"]), return_inverse=True, return_counts=True)
        suspect = times > 1
        hits = dict(zip(replies["owner"].to_pylist(), replies["hits"].to_pylist()))
        for owner, a, b in self.shares(sent):
            if owner in hits:
                suspect[a:b] |= np.unpackbits(np.frombuffer(hits[owner], np.uint8))[:b - a].astype(bool)
        return _bits(chunk["chunk"][0].as_py(), chunk["pos"].to_numpy()[suspect[back]])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = arrow_schema(ddl)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def _bits(chunk: int, places: np.ndarray) -> pa.Table:
    """One row with the places as the bits of 64-bit words; none, if there is no place."""
    ddl = "chunk long, bits array<long>"
    if not len(places):
        return _table([], ddl)
    flags = np.zeros(-(-(int(places.max()) + 1) // 64) * 64, np.uint8)
    flags[places] = 1
    return _table([(chunk, np.packbits(flags, bitorder="little").view(np.int64).tolist())], ddl)


def _bit(bits: str) -> Column:
    """Whether the row's place is set; false without bits."""
    return F.coalesce(F.getbit(F.get(bits, F.shiftright("pos", 6)), F.col("pos").bitwiseAND(63)), F.lit(0)) == 1


def _rows(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """The numbered rows, in a table bucketed by chunk: chunk, pos, doc_id, fp, text_sha256, text, row (``columns``)."""
    spark = docs.sparkSession
    number = F.col("number")
    rows = (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                        F.struct(*[F.col(f"`{c}`") for c in columns] or [F.lit(0).alias("none")]).alias("row"))
            .withColumn("number", F.monotonically_increasing_id()).withColumn("normal", normal(F.col("text")))
            .select(F.shiftright(number, CHUNK_BITS).alias("chunk"), number.bitwiseAND((1 << CHUNK_BITS) - 1).cast("int").alias("pos"),
                    "doc_id", F.xxhash64("normal").alias("fp"), F.sha2("normal", 256).alias("text_sha256"), "text", "row"))
    return bucketed(rows, "exact_rows", "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")))


def _settle(table: DataFrame) -> DataFrame:
    """Written: chunk, pos, doc_id, keep_id, group_size, kept, text_sha256 of every row of ``table``."""
    spark = table.sparkSession
    exchange = _Exchange(table.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    prints = table.select("chunk", "pos", "fp")
    messages = prints.groupBy("chunk").applyInArrow(lambda x: exchange.send(x), _MESSAGE)
    replies = messages.groupBy("owner").applyInArrow(lambda x: exchange.answer(x), _REPLY)
    marks = prints.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda x, y: exchange.mark(x, y), "chunk long, bits array<long>")
    marks = written(marks, "exact_marks")
    suspects = table.join(marks.hint("shuffle_hash"), "chunk").where(_bit("bits"))
    place = F.shiftleft("chunk", CHUNK_BITS).bitwiseOR(F.col("pos").cast("long"))
    groups = (suspects.select(normal(F.col("text")).alias("normal"), "doc_id", "text_sha256", place.alias("place"))
              .groupBy("normal", "text_sha256").agg(F.count("*").alias("size"), F.max("doc_id").alias("keep"),
                                                    F.max_by("place", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("stays"))
              .where("size > 1").select("text_sha256", "size", "keep", "stays"))
    groups = written(groups, "exact_groups")
    flagged = written(table.select("chunk", "pos", "doc_id", "text_sha256").join(marks.hint("shuffle_hash"), "chunk", "left")
                      .select("chunk", "pos", "doc_id", "text_sha256", _bit("bits").alias("suspect")), "exact_flags")
    alone = flagged.where("not suspect").select("chunk", "pos", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                F.lit(True).alias("kept"), "text_sha256")
    # Two written tables: a text of a third of all rows is a skewed key that the join splits.
    found = flagged.where("suspect").join(groups, "text_sha256", "left").select(
        "chunk", "pos", "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"), F.coalesce(F.col("stays") == place, F.lit(True)).alias("kept"), "text_sha256")
    return alone.unionAll(found)


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 of every row of ``docs``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, so null and empty texts are one
    group.  The row with the largest id stays; a null id is smaller than any.  Of rows that repeat id and text exactly one
    is kept, any of them.  A text of any length is compared whole.  An empty table gives no rows.  Other columns are not read.
    """
    table = _rows(docs, id_col, text_col, [])
    out = _settle(table).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    discard(docs.sparkSession, table)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mark`` keeps, all columns as they are, whatever their names."""
    table = _rows(docs, id_col, text_col, docs.columns)
    gone = _settle(table).where("not kept").groupBy("chunk").applyInArrow(
        lambda x: _bits(x["chunk"][0].as_py(), x["pos"].to_numpy()), "chunk long, bits array<long>")
    return table.join(written(gone, "exact_gone").hint("shuffle_hash"), "chunk", "left").where(~_bit("bits")).select("row.*")
