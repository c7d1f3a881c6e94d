"""Mixing, top-k, chat: SQL oracles and odd rows; the pipeline against plain stages."""

import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repolens.llm import chat, mixing, topk
from repolens.llm.common import written
from repolens.llm.queries import ORACLES, QUERIES

from .cases import corpus, frame, same

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from oracle_check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(cols) and rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_mix_odd_rows(spark):
    rows = corpus(7)
    docs = frame(spark, rows)
    got = mixing.mix(docs)
    assert got.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    again = mixing.mix(docs.repartition(5))
    same([(r.doc_id, r.text, r.copy) for r in got.collect()], [(r.doc_id, r.text, r.copy) for r in again.collect()])
    assert mixing.mix(docs.where("false")).count() == 0
    only = mixing.mix(docs, {"s1": 1.0})
    assert {r.source for r in only.collect()} == {"s1"}
    assert mixing.mix(docs, {}).count() == 0


def test_mix_hits_the_target(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("abcde").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 == 1, "b").alias("source"))
    want = {"a": 0.5, "b": 0.25}
    n = {r.source: r["count"] for r in mixing.mix(docs, want).groupBy("source").count().collect()}
    assert abs(n["a"] - 20_000) < 600 and abs(n["b"] - 10_000) < 600 and None not in n  # rates 2 and about 33
    copies = mixing.mix(docs.where("source = 'a'"), {"a": 1.0}).groupBy("doc_id").count().groupBy("count").count().collect()
    for r in copies:
        k, share = r[0], r[1] / 10_000
        assert abs(share - math.exp(-1) / math.factorial(k)) < 0.02


def brute_top(rows, k, asks):
    out = []
    vec = lambda v: [math.floor(1024 * x) for x in v]
    ok = [(i, vec(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if asks(i):
            queries.setdefault(i, []).append(v)
    raw = {}
    for i, v in rows:
        if i in queries and v is not None and all(x is not None and math.isfinite(x) for x in v):
            raw.setdefault(i, []).append(v)
    for q in queries:
        mine = vec(min(raw[q]))
        hits = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return out


@pytest.mark.parametrize("warm, block, coordinate", [(2048, 8192, 0.6), (8, 16, 0.0), (16, 8, 0.3)])
def test_top_k(spark, warm, block, coordinate, monkeypatch):
    import random
    r = random.Random(warm)
    rows = [(i, [r.gauss(0, 1) * (10 if i % 7 == 0 else 1) for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[i % 5][1]) for i in range(200, 230)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")]), (304, []), (305, [0.0] * 6), (306, [1.0]), (None, [1.0] * 6),
             (10, rows[10][1]), (20, rows[21][1]), (310, [])]
    for name, value in (("WARM", warm), ("BLOCK", block), ("COORDINATE", coordinate), ("QUERY_BLOCK", 5)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, block string, length double")
    same(topk.top_k(df, F.col("vec_id") % 10 == 0, k=4).collect(), brute_top(rows, 4, lambda i: i % 10 == 0))


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    same(topk.top_k(df, F.col("vec_id") % 100 == 0).collect(), [(100, 1, 1, 2048 * 1024)])
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    same(topk.top_k(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).collect(), [])


TURNS = [
    (1, 0, "system", "be kind <|end|>\n"), (1, 1, "user", "hi <|turn|>x<|says|>y" + " long" * 30), (1, 2, "assistant", "<\\|a <\\\\|b <| <|| \\<|" + "q" * 90),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "w" * 900), (1, 6, "user", "z" * 40), (1, 7, "assistant", "né日" * 20),
    (2, 0, "system", "alone"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, 0, None, "b"), (3, None, "ro<|says|>le\n", "c"), (4, 1, "system", "s" * 2000), (4, 2, "assistant", "t"),
    (None, 1, "user", "u"), (None, 2, "assistant", "v"),
]


@pytest.mark.parametrize("budget, history", [(256, 64), (40, 20), (1, 0), (10_000, 100)])
def test_chat_round_trip(spark, budget, history):
    df = spark.createDataFrame([(*t, 1, "c") for t in TURNS], "conv_id long, turn long, role string, text string, s int, window string").repartition(4)
    w = chat.windows(df, budget, history)
    read = chat.read_back(w).orderBy("conv_id", "window").collect()
    for c in {t[0] for t in TURNS}:
        want = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == c))
        turns = [(x.role, x.text) for r in read if r.conv_id == c for x in r.turns]
        assert turns == [x[2:] for x in want]
        assert [x for r in read if r.conv_id == c for x in r.learned] == [x[3] for x in want if x[2] == "assistant"]
    system = {r.conv_id: r.system_chars for r in w.collect()}
    for r in w.collect():
        own = r.text[r.new_from:]
        assert r.text[:r.new_from].count(chat.BEGIN) == r.text[:r.new_from].count(chat.END)
        cell = max(1, budget - history - math.ceil(system[r.conv_id] / 4))
        assert own.count(chat.BEGIN) == 1 or math.ceil(len(own) / 4) <= cell
        assert r.new_from - r.system_chars <= 4 * history
        for x in r.loss:
            assert x.start >= r.new_from and r.text[:x.start].endswith("assistant" + chat.SAYS) and r.text[x.start + x.length:].startswith(chat.END)


def test_chat_digests(spark):
    import hashlib
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.windows(df)).collect()}
    for c in {t[0] for t in TURNS}:
        want = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == c))
        learned = "".join(x[3] for x in want if x[2] == "assistant")
        assert got[c].n_turns == len(want) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in want).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.digests(chat.windows(df.where("false"))).count() == 0


def test_native_plans_run_no_python(spark):
    for name in ("op3_mix_sources", "op6_chat_windows", "op8_benchmark_leaks"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")), name


def test_pipeline_on_odd_rows(spark):
    docs = frame(spark, corpus(9)).drop("copy")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "t")
        assert out.columns == (columns if name != "mixing sources" else [*columns, "copy"])
        empty = written(stage(spark, docs.where("false"), SF), "t")
        assert empty.count() == 0 and empty.columns == out.columns
        if name == "language ID":
            letters = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
            kept = {(r.doc_id, r.text) for r in out.collect()}
            assert kept <= set(letters) and {x for x in letters if len(x[1].split()) >= 20} <= kept
        if name == "n-gram Jaccard join":
            from .cases import jaccard_components
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            stay = {d for d, _, c in jaccard_components(rows) if d is not None and d == c}
            assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(stay)
        docs = out


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.known_language(spark, docs, SF)
    assert out.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert corpus_pipeline.run(spark, SF).count() > 0
