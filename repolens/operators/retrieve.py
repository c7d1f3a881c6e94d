"""Retrieval over code and text: chunks, documents, vectors, nearest
neighbours, tree summaries, routing (R1-R7)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import REPO
from ..plans.helpers import spread
from ..session import cut_lineage
from .annotate import annotate, render
from .store import PLACE, KeptRows, append, content_key, for_calls

# Chunk size in tokens and the overlap carried between chunks.
CHUNK_SIZE = 1024
CHUNK_OVERLAP = 200

_SENT = re.compile(r"(?<=[.!?])\s+")


def _tokens(s: str) -> int:
    return -(-len(s) // 4)


def _halves(word: str, size: int, counter) -> list[str]:
    """A word longer than a chunk, cut by characters until its parts fit."""
    if counter(word) <= size or len(word) < 2:
        return [word]
    mid = len(word) // 2
    return _halves(word[:mid], size, counter) + _halves(word[mid:], size, counter)


def split_chunks(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 counter=_tokens) -> list[str]:
    """Greedy sentence packing (R1): sentences are added while the chunk
    stays within ``size`` tokens; a new chunk starts with the previous
    chunk's trailing sentences up to ``overlap`` tokens; a sentence longer
    than ``size`` is cut at word boundaries, a longer word by characters.
    The whole text is covered."""
    if not text:
        return []
    sents = []
    for s in _SENT.split(text):
        if not s:
            continue
        if counter(s) <= size:
            sents.append(s)
        else:
            sents += _packed([x for w in s.split(" ") for x in _halves(w, size, counter)], size, 0, counter)
    return _packed(sents, size, overlap, counter)


def _packed(parts: list[str], size: int, overlap: int, counter) -> list[str]:
    """Consecutive parts joined by a space while they stay within ``size``
    tokens; each text begins with the last parts of the one before, up to
    ``overlap`` tokens.  ``_tokens`` needs the length only, which is kept as
    it grows; another counter sees the joined text."""
    def count(own: list[str], chars: int) -> int:
        return -(-chars // 4) if counter is _tokens else counter(" ".join(own))

    out, cur, chars = [], [], 0
    for s in parts:
        grown = chars + len(s) + (1 if cur else 0)
        if cur and count([*cur, s] if counter is not _tokens else cur, grown) > size:
            out.append(" ".join(cur))
            keep, kept = [], 0
            for t in reversed(cur if overlap else []):
                more = kept + len(t) + (1 if keep else 0)
                if count([t] + keep if counter is not _tokens else keep, more) > overlap:
                    break
                keep, kept = [t] + keep, more
            more = kept + len(s) + (1 if keep else 0)
            fits = count([*keep, s] if counter is not _tokens else keep, more) <= size
            cur, grown = (keep, more) if fits else ([], len(s))
        cur.append(s)
        chars = grown
    if cur:
        out.append(" ".join(cur))
    return out


def chunk(df: DataFrame, id_col: str, text_col: str, index_name: str = "summary",
          size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
          meta_cols: list[str] | None = None) -> DataFrame:
    """Documents -> chunks (index_name, doc_id, chunk_no, text, n_tokens,
    metadata) (R1).  One document per row; the packing is a small per-row
    helper inside ``mapInPandas``."""
    meta_cols = meta_cols or []
    schema = ("index_name string, doc_id string, chunk_no int, text string, n_tokens bigint, "
              "metadata map<string,string>")

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                d = rec._asdict()
                meta = {c: None if d[c] is None else str(d[c]) for c in meta_cols}
                for i, t in enumerate(split_chunks(d["chunk_src_text"] or "", size, overlap)):
                    rows.append((index_name, str(d["chunk_src_id"]), i, t, _tokens(t), meta))
            yield pd.DataFrame(rows, columns=["index_name", "doc_id", "chunk_no", "text",
                                              "n_tokens", "metadata"])

    src = df.select(F.col(id_col).alias("chunk_src_id"), F.col(text_col).alias("chunk_src_text"),
                    *meta_cols)
    return spread(src, "chunk_src_id").mapInPandas(run, schema)


def description_docs(functions: DataFrame) -> DataFrame:
    """Function-description documents (R2): named functions with a
    description; metadata file and function."""
    f = functions.filter(F.col("name").isNotNull() & F.col("description").isNotNull())
    return f.select(*REPO, F.col("description").alias("text"),
                    F.create_map(F.lit("filename"), F.col("file_path"),
                                 F.lit("function_name"), F.col("name")).alias("metadata"))


def source_docs(functions: DataFrame) -> DataFrame:
    """Function-source documents (R3): named functions with code; metadata
    file, function and location."""
    f = functions.filter(F.col("name").isNotNull() & F.col("code").isNotNull())
    return f.select(*REPO, F.col("code").alias("text"),
                    F.create_map(F.lit("filename"), F.col("file_path"),
                                 F.lit("function_name"), F.col("name"),
                                 F.lit("location"), F.to_json("location")).alias("metadata"))


class HashingEmbedder:
    """Offline embedder: hashed bag of words into ``dim`` buckets, L2
    normalised (a stand-in for an embedding service)."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts):
        import zlib
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                out[i, zlib.crc32(w.encode()) % self.dim] += 1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        n[n == 0] = 1.0
        return (out / n).tolist()


def embed(df: DataFrame, text_col: str, embedder, out: str = "embedding", store_path: str | None = None,
          model: str = "offline-embedder") -> DataFrame:
    """Rows with a vector for ``text_col`` from an injected embedder.

    With ``store_path`` the vectors are kept in a store by the hash of model
    and text (``operators.store``): a text that is there already is not
    embedded again, and a text that many rows share is embedded once."""
    if store_path is not None:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = KeptRows(df.withColumn("_key", content_key(model, text)))
        asks = rows.missing(store_path, F.col("vector").isNotNull())
        if not asks.isEmpty():
            todo, dealt = for_calls(rows.picked(asks, "_asked").select(F.col("_asked").alias("key"), text.alias("prompt")), store_path)
            append(_embedded(todo, "prompt", embedder, "vector").withColumn("model", F.lit(model)), store_path, dealt)
        vectors = rows.entries(store_path, "vector").select(F.col("key").alias("_stored"), F.col("vector").alias(out))
        return rows.table.join(vectors, F.col("_key") == F.col("_stored"), "left").drop("_stored", "_key", *PLACE)
    return _embedded(spread(df), text_col, embedder, out)


def _embedded(df: DataFrame, text_col: str, embedder, out: str) -> DataFrame:
    from pyspark.sql import types as T

    def run(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf[out] = embedder(list(pdf[text_col])) if len(pdf) else []
            yield pdf

    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


# Vectors and queries of a block: what one task multiplies at once.
QUERY_BLOCK = 1024
VECTOR_BLOCK = 16_384


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1)
    n[n == 0] = np.inf
    return m / n[:, None]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, q_id: str = "query_id",
            q_vec: str = "query", v_id: str = "vec_id", v_vec: str = "embedding") -> DataFrame:
    """Exact k nearest vectors by cosine similarity per query.

    Queries and vectors are dealt to blocks by a hash of their ids; each pair
    of blocks is one matrix product that keeps the block's top k per query
    (ties by vector id).  Neither side passes the driver, no pair table is
    made, and the final top k runs on k rows per query and vector block.
    Output: query_id, rank, vec_id, sim (double).
    """
    def blocks(df, size):
        return max(1, -(-df.count() // size))

    nq, nv = blocks(queries, QUERY_BLOCK), blocks(vectors, VECTOR_BLOCK)
    qs = queries.select(F.col(q_id).alias("query_id"), F.col(q_vec).cast("array<double>").alias("q")).withColumn(
        "qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn(
        "vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    vs = vectors.select(F.col(v_id).alias("vec_id"), F.col(v_vec).cast("array<double>").alias("v")).withColumn(
        "of_vb", F.pmod(F.xxhash64("vec_id"), F.lit(nv)).cast("int")).withColumn(
        "of_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def top(q, v):
        out = {"query_id": [], "vec_id": [], "sim": []}
        if len(q) and len(v):
            sims, ids = _unit(q["q"]) @ _unit(v["v"]).T, v["vec_id"].to_numpy()
            for qid, row in zip(q["query_id"], sims):
                # the k-th largest bounds what has to be sorted; its ties stay in
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                at = np.flatnonzero(row >= least)
                at = at[np.lexsort((ids[at], -row[at]))][:k]
                out["query_id"] += [qid] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["sim"] += row[at].tolist()
        return pd.DataFrame(out)

    schema = f"query_id {dict(qs.dtypes)['query_id']}, vec_id {dict(vs.dtypes)['vec_id']}, sim double"
    cand = qs.groupBy("qb", "vb").cogroup(vs.groupBy("of_qb", "of_vb")).applyInPandas(top, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("vec_id"))
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "sim"))


def centroids(vectors: DataFrame, by: str, v_vec: str = "embedding") -> DataFrame:
    """Mean vector per group (query vectors for R5): per-dimension averages
    (partial aggregation), folded back into an array per group."""
    per_dim = (vectors.select(by, F.posexplode(v_vec).alias("_d", "_x"))
               .groupBy(by, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m")))
    return (per_dim.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_a"))
            .select(by, F.transform("_a", lambda s: s["_m"]).alias("centroid")))


# Pieces of a partition when a level is packed.
PACK_PIECES = 4096


def _pack(pieces: DataFrame, group: list[str], fan_in: int, max_tokens: int) -> DataFrame:
    """Consecutive pieces of a group joined into blocks of ``fan_in`` pieces
    and ``max_tokens`` tokens at most, but of two pieces at least, so that
    each level halves their number whatever the length of the answers.
    Pieces are range partitioned by group and order, so a group of any size
    spreads over tasks; a block just ends where a partition does."""
    n = max(1, pieces.count() // PACK_PIECES)
    rows = pieces.repartitionByRange(n, *group, "_o").sortWithinPartitions(*group, "_o")
    cols = [*group, "_o", "_t"]

    def run(batches):
        key, first, parts, size = None, None, [], 0

        def block():
            return [*key, first, "\n\n".join(parts)]
        for pdf in batches:
            out = []
            for *g, o, t in pdf[cols].itertuples(index=False, name=None):
                tokens = _tokens(t or "")
                full = len(parts) >= 2 and (len(parts) >= fan_in or size + tokens > max_tokens)
                if parts and (tuple(g) != key or full):
                    out.append(block())
                    parts, size = [], 0
                if not parts:
                    key, first = tuple(g), o
                parts.append(t or "")
                size += tokens
            yield pd.DataFrame(out, columns=[*group, "_o", "_j"])
        if parts:
            yield pd.DataFrame([block()], columns=[*group, "_o", "_j"])

    kinds = dict(pieces.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in [*group, "_o"]] + ["_j string"])
    return rows.select(*cols).mapInPandas(run, schema)


def tree_summarise(chunks: DataFrame, group: list[str], order: str, text: str, completer,
                   cache_path: str, fan_in: int = 8, model: str = "offline",
                   max_tokens: int = 8000, stem: Column | None = None) -> DataFrame:
    """Summary of all chunks of each group, level by level (R6): consecutive
    pieces are joined and summarised until one piece per group is left.  A
    group that is down to one piece is finished and not summarised again;
    ``levels`` is the number of levels it took.  ``stem`` is the instruction,
    an expression of the group columns."""
    stem = F.lit("Summarize:") if stem is None else stem

    def level_of(pieces):
        packed = _pack(pieces, group, fan_in, max_tokens)
        summ = annotate(packed, F.concat(stem, F.lit("\n"), F.col("_j")), completer, cache_path, model, out="_t")
        # written to the shared checkpoint folder: the next level starts here
        return cut_lineage(summ.select(*group, "_o", F.coalesce("_t", F.lit("")).alias("_t")))

    cur = level_of(chunks.select(*group, F.col(order).alias("_o"), F.col(text).alias("_t")))
    done, level = None, 1
    while True:
        one = cur.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.first("_t").alias("_t"))
        end = one.filter("_n = 1").select(*group, F.col("_t").alias("summary"), F.lit(level).alias("levels"))
        done = end if done is None else done.unionByName(end)
        open_ = one.filter("_n > 1").select(*group)
        if open_.isEmpty():
            return done
        same = [cur[c].eqNullSafe(open_[c]) for c in group]
        cur = level_of(cur.join(open_, same, "left_semi"))
        level += 1


# The three indexes a question can be routed to.
TOOLS = {
    "summary": "Overviews: what a repository or one of its parts does as a whole.",
    "vector": "Facts in plain words, found in the descriptions of functions and files.",
    "code_vector": "Details of how something is written, found in the code.",
}


def route(questions: DataFrame, text: str, completer, cache_path: str,
          tools: dict[str, str] = TOOLS, model: str = "offline") -> DataFrame:
    """Pick one index per question (R7): the model sees the tool list and the
    question; answers outside the tool names fall back to the first tool."""
    listing = "\n".join(f"{k}: {v}" for k, v in tools.items())
    p = render("Tools:\n" + listing.replace("{", "(").replace("}", ")") + "\nQuestion:\n{q}", q=text)
    ans = annotate(questions, p, completer, cache_path, model, out="_tool")
    first = next(iter(tools))
    return ans.withColumn("index_name", F.when(F.col("_tool").isin(*tools), F.col("_tool"))
                          .otherwise(F.lit(first))).drop("_tool")


def search_routed(questions: DataFrame, index: DataFrame, k: int, q_id: str = "query_id", q_vec: str = "query",
                  v_id: str = "vec_id", v_vec: str = "embedding") -> DataFrame:
    """Exact k nearest chunks per question by cosine, each question in the
    index that it was routed to (R7 into S14): query_id, index_name, rank,
    vec_id, sim.

    ``questions`` and ``index`` have ``index_name``; the stored index is
    partitioned by it (``write_index``), and the scan opens only the
    partitions that some question was routed to, which it learns while the
    query runs (dynamic partition pruning).  Questions and chunks are dealt
    to blocks, as in ``nearest``.
    """
    def blocks(df, size):
        return max(1, -(-df.count() // size))

    asked = cut_lineage(questions.filter(F.col("index_name").isin(*TOOLS)).select(
        "index_name", F.col(q_id).alias("query_id"), F.col(q_vec).cast("array<double>").alias("q")))
    # At most one row per index.  The comparison holds for every name; Spark prunes partitions only by a filtered side.
    routed = asked.filter(F.length("index_name") > 0).select("index_name").distinct()
    held = index.join(F.broadcast(routed), "index_name", "left_semi").select(
        "index_name", F.col(v_id).alias("vec_id"), F.col(v_vec).cast("array<double>").alias("v"))
    nq, nv = blocks(asked, QUERY_BLOCK), blocks(held, VECTOR_BLOCK)
    deal = lambda df, c, n, to: df.withColumn(to, F.pmod(F.xxhash64(c), F.lit(n)).cast("int"))
    copy = lambda df, n, to: df.withColumn(to, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    qs = copy(deal(asked, "query_id", nq, "qb"), nv, "vb")
    vs = copy(deal(held, "vec_id", nv, "vb"), nq, "qb")

    def top(q, v):
        out = {"query_id": [], "index_name": [], "vec_id": [], "sim": []}
        if len(q) and len(v):
            sims, ids = _unit(q["q"]) @ _unit(v["v"]).T, v["vec_id"].to_numpy()
            for qid, row in zip(q["query_id"], sims):
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                at = np.flatnonzero(row >= least)
                at = at[np.lexsort((ids[at], -row[at]))][:k]
                out["query_id"] += [qid] * len(at)
                out["index_name"] += [q["index_name"].iloc[0]] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["sim"] += row[at].tolist()
        return pd.DataFrame(out)

    schema = f"query_id {dict(asked.dtypes)['query_id']}, index_name string, vec_id {dict(held.dtypes)['vec_id']}, sim double"
    key = ["index_name", "qb", "vb"]
    found = qs.groupBy(*key).cogroup(vs.groupBy(*key)).applyInPandas(top, schema)
    w = Window.partitionBy("query_id", "index_name").orderBy(F.desc("sim"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "index_name", "rank", "vec_id", "sim"))
