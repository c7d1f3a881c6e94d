"""Token counts without token ids.

A byte-level BPE never merges across a pre-token border, so the tokens of a text are the sum over its pre-tokens.  Each
distinct pre-token is tokenised once; documents only carry how often they use each.

1. Scan: the texts of a task are cut into pre-tokens and gathered into blocks of about ``BLOCK`` bytes.  A block numbers
   its distinct pre-tokens, sorted within vocabulary buckets (a hash of the pre-token).  It yields its documents, as packed
   numbers and frequencies, and for each bucket its pre-tokens, as one packed list.  Both are written to one table.
2. The lists meet by bucket: each distinct pre-token is counted by the tokeniser once there.  The counts go back as one
   packed list per block and bucket.
3. Each block's documents take their sums.

Nothing is broadcast and no text is shuffled.  A pre-token that every document uses still occurs once per block, and
buckets are as many as the shuffle partitions, so no key is hot.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, pack, scan, unpack, written

BLOCK = 16 << 20
CHUNK = 512  # documents of a packed row
CACHE = 1 << 21  # counted pre-tokens that a task remembers; beyond, it starts anew

_ROWS = "block long, bucket int, doc_id binary, known binary, n_bytes binary, fixed binary, used binary, ids binary, freqs binary, pieces binary"
_COUNTS = "doc_id long, n_bytes long, n_tokens long"

#: From here on the regex library and the tokeniser know different Unicode versions: such texts are cut by the tokeniser.
_SURE = 0x550


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _cutter(path: str, pattern: str):
    """text -> (its pre-tokens, number of special strings in it)"""
    import regex
    t = _tokenizer(path)
    cut = regex.compile(pattern).findall
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    between = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
    plain = regex.compile(f"[\\x00-{chr(_SURE - 1)}]*").fullmatch

    def pieces(text: str) -> list[str]:
        if text.isascii() or plain(text):
            return cut(text)
        return [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]

    def both(text: str) -> tuple[list[str], int]:
        if between is None or not any(x in text for x in special):
            return pieces(text), 0
        parts = between.split(text)
        return [p for part in parts for p in pieces(part)], len(parts) - 1
    return both


def _pack(x: np.ndarray | bytes) -> bytes:
    return pack(x if isinstance(x, bytes) else x.tobytes())


def _steps(ids: np.ndarray) -> np.ndarray:
    """Sorted numbers as 16-bit steps; 65535 says: go on by that much, no number yet."""
    gaps = np.diff(ids, prepend=0)
    far = gaps // 0xFFFF
    if not far.any():
        return gaps.astype(np.uint16)
    out = np.full(len(ids) + int(far.sum()), 0xFFFF, np.uint16)
    out[np.arange(len(ids)) + np.cumsum(far)] = gaps % 0xFFFF
    return out


def _blocks(path: str, pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        schema, cut = arrow_schema(_ROWS), _cutter(path, pattern)
        base, serial = (TaskContext.get().partitionId() + 1) << 32, 0
        vocab: dict[str, int] = {}
        docs: list[tuple] = []
        size = 0

        def row(**x) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({f.name: [x.get(f.name)] for f in schema} | {"block": [base + serial]}, schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            lists: list[list[str]] = [[] for _ in range(buckets)]
            for p in vocab:
                lists[crc32(p.encode("utf-8", "surrogatepass")) % buckets].append(p)
            number, at = np.zeros(len(vocab), np.int64), 0
            for i, names in enumerate(lists):
                if names:
                    names.sort()
                    number[np.fromiter(map(vocab.__getitem__, names), np.int64, len(names))] = np.arange(at, at + len(names))
                    at += len(names)
                    yield row(bucket=i, used=_pack(np.fromiter(map(len, names), np.int64, len(names))), pieces=_pack("".join(names).encode()))
            for a in range(0, len(docs), CHUNK):
                part, ids, freqs = docs[a:a + CHUNK], [], []
                for d in part:
                    mine = number[d[3]]
                    order = np.argsort(mine)
                    mine, freq = mine[order], d[4][order]
                    if len(freq) and freq.max() > 255:  # one byte each: a larger one is split up
                        more = np.maximum(1, -(-freq // 255))
                        last = np.cumsum(more) - 1
                        mine, rest, freq = np.repeat(mine, more), freq - (more - 1) * 255, np.full(int(more.sum()), 255)
                        freq[last] = rest
                    ids.append(_steps(mine))
                    freqs.append(freq.astype(np.uint8))
                yield row(doc_id=_pack(np.array([d[0] or 0 for d in part], np.int64)), known=_pack(np.array([d[0] is not None for d in part])),
                          n_bytes=_pack(np.array([d[1] for d in part], np.int64)), fixed=_pack(np.array([d[2] for d in part], np.int64)),
                          used=_pack(np.array([[len(x), len(y)] for x, y in zip(ids, freqs)], np.int64)),
                          ids=_pack(np.concatenate(ids)), freqs=_pack(np.concatenate(freqs)))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                n_bytes = len(text) if text.isascii() else len(text.encode())
                found, fixed = cut(text)
                seen = Counter(found)
                for p in seen:
                    if p not in vocab:
                        vocab[p] = len(vocab)
                docs.append((doc_id, n_bytes, fixed, np.fromiter(map(vocab.__getitem__, seen), np.int64, len(seen)),
                             np.fromiter(seen.values(), np.int64, len(seen))))
                size += n_bytes + 64
                if size >= BLOCK:
                    yield from flush()
                    vocab.clear()
                    docs.clear()
                    serial, size = serial + 1, 0
        if docs:
            yield from flush()
    return run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = _tokenizer(path), {}
        for batch in batches:
            for block, bucket, used, packed in zip(*(c.to_pylist() for c in batch.columns)):
                text, edges = unpack(packed).decode(), np.cumsum(np.frombuffer(unpack(used), np.int64)).tolist()
                names = [text[i:j] for i, j in zip([0, *edges], edges)]
                new = [p for p in names if p not in known]
                if len(known) + len(new) > CACHE:
                    known, new = {}, names
                for a in range(0, len(new), 8192):
                    part = new[a:a + 8192]
                    known.update(zip(part, (len(e) for e in t.encode_batch_fast(part, add_special_tokens=False))))
                counts = np.fromiter(map(known.__getitem__, names), np.uint32, len(names))
                yield pa.RecordBatch.from_pydict({"of": [block], "part": [bucket], "counts": [_pack(counts)]},
                                                 schema=arrow_schema("of long, part int, counts binary"))
    return run


def _sum(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    n = np.frombuffer(b"".join(unpack(x) for x in counts.sort_values("part")["counts"]), np.uint32).astype(np.int64)
    out = []
    for d in docs.itertuples():
        long = lambda x: np.frombuffer(unpack(x), np.int64)
        used = long(d.used).reshape(-1, 2)
        steps, freqs = np.frombuffer(unpack(d.ids), np.uint16), np.frombuffer(unpack(d.freqs), np.uint8)
        at = np.cumsum(steps.astype(np.int64))
        edges = np.concatenate([[0], np.cumsum(used[:, 0])])
        at -= np.repeat(np.concatenate([[0], at])[edges[:-1]], used[:, 0])  # each document starts anew
        total = np.concatenate([[0], np.cumsum(n[at[steps != 0xFFFF]] * freqs)])
        ends = np.concatenate([[0], np.cumsum(used[:, 1])])
        ids = pd.array(long(d.doc_id), "Int64")
        ids[~np.frombuffer(unpack(d.known), bool)] = pd.NA
        out.append(pd.DataFrame({"doc_id": ids, "n_bytes": long(d.n_bytes), "n_tokens": np.diff(total[ends]) + long(d.fixed)}))
    return pd.concat(out)


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, ``pattern`` the pre-token pattern that it
    names.  Special strings inside a text count as one token each, as the library reads them by default.  A null or empty
    text has 0 bytes and 0 tokens; repeated rows are counted each; a null id stays null; an empty table gives no rows;
    other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = written(scan(rows, _blocks(tokenizer, pattern, buckets), _ROWS), "token_blocks")
    lists = table.where("bucket is not null").select("block", "bucket", "used", "pieces").repartition(buckets, "bucket")
    counted = scan(lists, _count(tokenizer), "of long, part int, counts binary")
    sums = (table.where("bucket is null").drop("bucket", "pieces").groupBy("block")
            .cogroup(counted.groupBy("of")).applyInPandas(_sum, _COUNTS))
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
