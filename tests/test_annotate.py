"""Batch annotation: cache, zero calls on re-run, shorten loop, garbage
guard, pricing (L1-L10, A16)."""

import os

import pytest
from pyspark.sql import functions as F

from repolens.operators import annotate as L


class Counting:
    """Completer that records every prompt it answers in a folder (tasks
    run in other processes), answering with the prompt's length."""

    def __init__(self, folder, reply=None):
        self.folder, self.reply = folder, reply

    def __call__(self, prompts):
        import uuid
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(str(len(prompts)))
        return [self.reply(p) if self.reply else f"len={len(p)}" for p in prompts]


def calls(folder):
    return sum(int(open(os.path.join(folder, f)).read()) for f in os.listdir(folder))


def test_second_run_makes_zero_calls(spark, tmp):
    log = os.path.join(tmp, "calls")
    os.makedirs(log)
    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "id int, t string")
    p = L.render("Describe: {t}", t="t")
    cache = os.path.join(tmp, "cache")
    a = L.annotate(df, p, Counting(log), cache).collect()
    assert calls(log) == 5                        # one call per distinct prompt
    assert {r.answer for r in a} == {f"len={len('Describe: text 0')}"}
    b = L.annotate(df, p, Counting(log), cache).collect()
    assert calls(log) == 5                        # cache hit: no new calls
    assert sorted((r.id, r.answer) for r in a) == sorted((r.id, r.answer) for r in b)
    # the key includes the model
    L.annotate(df, p, Counting(log), cache, model="other").collect()
    assert calls(log) == 10


def test_shorten_loop(spark, tmp):
    df = spark.createDataFrame([("a.py", "x" * 50), ("b.py", "short")], "filename string, d string")
    # each round halves the text; 50 -> 25 -> 12 -> 6: short enough (<= 8) after 3 rounds
    halve = L.ExtractiveCompleter  # noqa: F841  (shape reference)

    class Halve:
        def __call__(self, prompts):
            return [p.rsplit("\n", 1)[-1][: len(p.rsplit("\n", 1)[-1]) // 2] for p in prompts]

    out = {r.filename: r.d for r in L.shorten(df, "d", Halve(), os.path.join(tmp, "c1"), max_len=8).collect()}
    assert out == {"a.py": "x" * 6, "b.py": "short"}
    out = {r.filename: r.d for r in L.shorten(df, "d", Halve(), os.path.join(tmp, "c2"), max_len=1,
                                               rounds=2).collect()}
    assert out["a.py"] is None                    # never short enough -> NULL


def test_garbage_guard(spark, tmp):
    # garbage and failed calls cost their own rows only; the next run asks those again
    df = spark.createDataFrame([(f"t{i}",) for i in range(150)], "t string")

    def bad(ps):
        if "t77" in ps:
            raise RuntimeError("service down")
        return ["@@@ nonsense" if p == "t5" else p.upper() for p in ps]

    path = os.path.join(tmp, "c")
    got = {r.t: r.answer for r in L.annotate(df, F.col("t"), bad, path).collect()}
    assert got == {f"t{i}": None if i in (5, 77) else f"T{i}" for i in range(150)}
    assert {r.prompt for r in L.rejects(spark, path).collect()} == {"t5", "t77"} and L.cache_size(spark, path) == 148
    again = {r.t: r.answer for r in L.annotate(df, F.col("t"), lambda ps: [f"new {p}" for p in ps], path).collect()}
    assert again["t5"] == "new t5" and again["t77"] == "new t77" and again["t6"] == "T6"
    assert L.rejects(spark, path).count() == 0


def test_price_calls(spark):
    calls_df = spark.createDataFrame([("openai", "m", 1000000, 2000000), ("ollama", "z", 5, 5)],
                                     "service string, model string, input_tokens bigint, output_tokens bigint")
    prices = spark.createDataFrame([("openai", "m", 0.15, 0.6), ("ollama", "z", 0.0, 0.0)],
                                   "service string, model string, input double, output double")
    got = {r.service: float(r.cost) for r in L.price_calls(calls_df, prices).collect()}
    assert got == {"openai": 1.35, "ollama": 0.0}


def test_price_list_with_a_repeated_entry_fails(spark):
    calls_df = spark.createDataFrame([("o", "m", 1, 1), ("o", "none", 1, 1)], "service string, model string, input_tokens bigint, output_tokens bigint")
    prices = spark.createDataFrame([("o", "m", 0.15, 0.6)], "service string, model string, input double, output double")
    assert {r.model: r.cost is None for r in L.price_calls(calls_df, prices).collect()} == {"m": False, "none": True}
    with pytest.raises(Exception, match="repeated entry"):
        L.price_calls(calls_df, prices.unionAll(prices)).collect()


def test_extractive_completer_reads_all_lines():
    c = L.ExtractiveCompleter(1000)
    assert c(["Summarize:\nline one\nline two"]) == ["Summarize: line one line two"]
    assert L.ExtractiveCompleter(3)(["a b c d e f"]) == ["a c e"] and c([""]) == [""]


def test_summaries_see_the_data(spark, tmp):
    ds = spark.createDataFrame([("o", "r", f"file{i}", i) for i in range(300)], "repo_owner string, repo_name string, f string, n int")
    spans = ds.groupBy("repo_owner", "repo_name").agg(F.lit(None).cast("timestamp_ntz").alias("first_date"), F.lit(None).cast("timestamp_ntz").alias("last_date"))

    class Names:
        def __call__(self, ps):
            import re
            return [" ".join(sorted(set(re.findall(r"file\d+", p)))) for p in ps]
    out = L.summarise_datasets({"churn-summary": ds}, spans, None, Names(), os.path.join(tmp, "c"), max_tokens=300).collect()
    assert len(out) == 1 and set(out[0].summary.split()) == {f"file{i}" for i in range(300)}
    stored = spark.createDataFrame([(x.repo_owner, x.repo_name, x.name, x.hash) for x in out], "repo_owner string, repo_name string, name string, hash string")
    again = L.summarise_datasets({"churn-summary": ds}, spans, stored, Names(), os.path.join(tmp, "c"))
    assert again.count() == 0


def test_keyword_tagger_feeds_parser(spark):
    t = L.KeywordTagger(["API", "Docs"])
    assert t(["the api and API docs"]) == ["API,2,Docs,1"]
    assert t(["nothing"]) == ["Other,1"]


def test_system_prompts_go_with_the_prompt(spark, tmp):
    assert set(L.TEMPLATES) | set(L.STEMS) == set(L.SYSTEM) and len(L.SYSTEM) == 12
    df = spark.createDataFrame([(1, "rate_code"), (2, "describe_code"), (3, "rate_code"), (4, None)], "id int, stem string")
    system = F.when(F.col("stem") == "rate_code", L.SYSTEM["rate_code"]).when(F.col("stem") == "describe_code", L.SYSTEM["describe_code"])

    def model(prompts, systems):
        if len(prompts) > 1:
            raise OSError("one by one")
        return [f"{p}|{s[:9]}" for p, s in zip(prompts, systems)]
    cache = os.path.join(tmp, "c")
    got = {r.id: r.answer for r in L.annotate(df, F.lit("x"), model, cache, system=system).collect()}
    assert got == {1: "x|You judge", 2: "x|You docum", 3: "x|You judge", 4: "x|"}
    assert L.cache_size(spark, cache) == 3
    # without a system prompt it is another question
    assert {r.answer for r in L.annotate(df, F.lit("x"), lambda p: ["plain"] * len(p), cache).collect()} == {"plain"}


def test_a_worker_holds_few_prompts(spark, tmp):
    # a batch of Spark's own size holds 10,000 whole files
    df = spark.range(1000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = L.annotate(df, F.col("text"), lambda ps: [str(len(ps))] * len(ps), tmp + "/c", max_callers=1, out="n")
    sizes = [int(r.n) for r in out.collect()]
    assert len(sizes) == 1000 and max(sizes) <= L.CALL_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == held
