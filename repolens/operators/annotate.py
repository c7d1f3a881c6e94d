"""Batch model annotation.

One operator, ``annotate``: render a prompt column, key it by a content
hash of (model, prompt), anti-join the store, call an injected completer on
the missing prompts inside ``mapInPandas`` (Arrow batches; the number of
concurrent callers is bounded by ``max_callers`` partitions), append the
answers to the store *before* joining back -- so every prompt is answered
once even when tasks are retried -- and join the answers onto the rows.

A completer is a picklable callable ``list[str] -> list[str]`` (or
``list[(text, prompt_tokens, completion_tokens)]``).  Model and embedding
HTTP clients are outside this library; tests and registered queries use the
deterministic offline completers defined here.
"""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import REPO
from ..session import cut_lineage
from .store import PLACE, KeptRows, append, content_key, for_calls, read_store

# Answer length limit, shorten rounds, garbage marker.
MAX_DESCRIPTION = 800
SHORTEN_ROUNDS = 5
GARBAGE_PREFIX = "@@@"
# Prompts that a Python worker holds at a time (whole files can be long).
CALL_ROWS = 256

CALLED = ("key string, model string, prompt string, answer string, "
          "prompt_tokens bigint, completion_tokens bigint")

# Prompt templates (L1).  Variables in braces are columns.
TEMPLATES = {
    "summarize_diff": "Filename: {filename}\n{clause}\n{data}",
    "shorter_summarize_diff": "Filename: {filename}\nShorten this summary:\n{long_summary}",
    "classify_description": "Tags: {tags}\nDescription:\n{description}",
    "summarize_pr": "Summarize these change descriptions:\n{prs}",
    "describe_code": "Filename: {filename}\nFunction: {func_name}\n{code}",
    "rate_code": "Rate readability 0-1.\nFilename: {filename}\nFunction: {func_name}\n{code}",
}


# What the model is told about its task before each prompt (L1): one text per
# stem, those of the data sets (L8) included.
SYSTEM = {
    "summarize_diff": "You explain changes to source files. Say in a few sentences what the change does and why it may matter. "
                      "The input is a unified diff or, without one, the whole file.",
    "shorter_summarize_diff": "You shorten summaries of changes. Keep what matters most and drop the rest.",
    "classify_description": "You sort changes into kinds of work. Answer with tag names from the given list, each followed by a whole "
                            "number for its weight, all separated by commas, and nothing else.",
    "summarize_pr": "You sum up pull requests. From the descriptions of their changes, tell a reviewer what the whole does.",
    "describe_code": "You document functions. Say in a few sentences what the function is for and how it works.",
    "rate_code": "You judge how readable code is. Answer with one number from 0 (unreadable) to 1 (very clear), and nothing else.",
    "author-commits-summary": "You report on teams. Describe how the work is spread and who knows which part, without praise or blame.",
    "file-commit-count-summary": "You report on code bases. Point out the files that change most and what that may mean.",
    "commit-count-by-date-summary": "You report on projects over time. Describe busy and quiet times and any trend.",
    "churn-summary": "You report on code bases. Describe where code is rewritten again and again.",
    "overall-tags-summary": "You report on projects. Describe what kinds of work are done, and in what shares.",
    "tags-by-week-summary": "You report on projects over time. Describe how the kinds of work shift from week to week.",
}


def render(template: str, **cols) -> Column:
    """Template text with ``{name}`` replaced by column values (L1); all
    pieces are concatenated JVM-side."""
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        c = cols[m.group(1)]
        parts.append(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def estimate_tokens(c) -> Column:
    """Token estimate: characters / 4, rounded up."""
    c = F.col(c) if isinstance(c, str) else c
    return F.ceil(F.length(c) / 4).cast("bigint")


def prompt_key(model: str, prompt: Column) -> Column:
    """Cache key = sha256 of model and prompt."""
    return content_key(model, prompt)


def _answers(completer, prompts: list[str], systems: list[str] | None = None) -> list:
    """One answer per prompt; when a batch fails its prompts are asked one
    by one, and those that fail again have none."""
    try:
        return completer(prompts) if systems is None else completer(prompts, systems)
    except Exception:
        if len(prompts) == 1:
            return [None]
        return [_answers(completer, [p], None if systems is None else [systems[i]])[0] for i, p in enumerate(prompts)]


def _call(completer, model):
    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            out = _answers(completer, list(pdf["prompt"]), list(pdf["system"]) if "system" in pdf else None)
            texts, pt, ct = [], [], []
            for prompt, o in zip(pdf["prompt"], out):
                if isinstance(o, tuple):
                    t, a, b = o
                else:
                    t, a, b = o, None, None
                t = None if t is None else str(t).strip()
                if t is not None and t.startswith(GARBAGE_PREFIX):
                    t = None                   # L4: a reject row, see ``rejects``
                texts.append(t)
                pt.append(a if a is not None else -(-len(prompt) // 4))
                ct.append(b if b is not None else -(-len(t or "") // 4))
            yield pd.DataFrame({"key": pdf["key"], "model": model, "prompt": pdf["prompt"],
                                "answer": texts, "prompt_tokens": pt, "completion_tokens": ct})
    return run


def annotate(df: DataFrame, prompt: Column, completer, cache_path: str, model: str = "offline",
             out: str = "answer", max_callers: int | None = None, system: Column | None = None) -> DataFrame:
    """Rows of ``df`` with the model's ``out`` answer to ``prompt``.

    With ``system`` (see ``SYSTEM``) the completer gets two lists, prompts and
    system prompts, and an answer belongs to both of them together.

    Work done: one call per distinct prompt not yet in the cache, a store
    (``operators.store``) at ``cache_path`` on shared storage; answers are
    appended before they are read back.  A garbage answer (L4) or a failed
    call costs its own row only: it is stored as a reject without an answer,
    the row's answer is NULL, and the next run asks again.
    """
    spark = df.sparkSession
    # the input is written once: the calls and the join back read the same
    # prompts, and the (possibly costly) upstream is not computed twice
    asked = df.withColumn("_prompt", prompt)
    content, more = F.col("_prompt"), []
    if system is not None:
        asked = asked.withColumn("_system", F.coalesce(system, F.lit("")))
        content, more = F.concat("_system", F.lit("\u0001"), "_prompt"), [F.col("_system").alias("system")]
    # a prompt that equals one of the row's texts is not written a second time
    texts = [F.col(f"`{c}`") for c, kind in df.dtypes if kind == "string"]
    same = F.coalesce(F.lit(None).cast("int"), *[F.when(c == F.col("_prompt"), F.lit(i)) for i, c in enumerate(texts)])
    rows = KeptRows(asked.withColumn("_key", prompt_key(model, content)).withColumn("_same", same)
                    .withColumn("_prompt", F.when(F.col("_same").isNull(), F.col("_prompt"))))
    kept = F.coalesce("_prompt", *[F.when(F.col("_same") == i, c) for i, c in enumerate(texts)])
    asks = rows.missing(cache_path, F.col("answer").isNotNull())
    if not asks.isEmpty():
        todo = rows.picked(asks, "_asked").select(F.col("_asked").alias("key"), kept.alias("prompt"), *more)
        # max_callers bounds the concurrent calls to a rate-limited service;
        # by default the calls spread over the cluster's cores
        todo, dealt = for_calls(todo, cache_path, max_callers)
        batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
        held = spark.conf.get(batch)
        spark.conf.set(batch, min(CALL_ROWS, int(held)) if int(held) > 0 else CALL_ROWS)
        try:
            append(todo.mapInPandas(_call(completer, model), CALLED), cache_path, dealt)
        finally:
            spark.conf.set(batch, held)
    answers = rows.entries(cache_path, "answer").select(F.col("key").alias("_key"), F.col("answer").alias(out))
    found = rows.table.select("_key", *PLACE).join(answers, "_key").drop("_key")
    return rows.given(found, out).drop(*PLACE, "_key", "_prompt", "_system", "_same")


def rejects(spark: SparkSession, cache_path: str) -> DataFrame:
    """Prompts that have got no usable answer yet (L4)."""
    cache = read_store(spark, cache_path)
    good = cache.filter("answer is not null").select("key")
    return cache.filter("answer is null").join(good, "key", "left_anti").select("key", "model", "prompt").distinct()


def cache_size(spark: SparkSession, cache_path: str) -> int:
    """Number of answers stored (each one model call)."""
    return read_store(spark, cache_path).filter("answer is not null").count()


def shorten(df: DataFrame, text: str, completer, cache_path: str, filename: str = "filename",
            max_len: int = MAX_DESCRIPTION, rounds: int = SHORTEN_ROUNDS,
            model: str = "offline") -> DataFrame:
    """Answers longer than ``max_len`` (after trim) are re-summarised, each
    round on the previous output, up to ``rounds`` times; NULL when never
    short enough (L3).  Each round touches only the rows still too long."""
    too_long = F.length(F.trim("_t")) > max_len
    rows = df.withColumn("_t", F.col(text))
    done, open_ = rows.filter(~too_long | F.col("_t").isNull()), rows.filter(too_long)
    p = render(TEMPLATES["shorter_summarize_diff"], filename=filename, long_summary="_t")
    for _ in range(rounds):
        if open_.isEmpty():
            break
        # only what is still too long is written again
        redo = annotate(open_, p, completer, cache_path, model, out="_new")
        after = cut_lineage(redo.withColumn("_t", F.col("_new")).drop("_new"))
        done = done.unionByName(after.filter(~too_long | F.col("_t").isNull()))
        open_ = after.filter(too_long)
    return (done.unionByName(open_).withColumn(text, F.when(F.length(F.trim("_t")) <= max_len, F.col("_t")))
            .drop("_t"))


def price_calls(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Cost per call = tokens x USD per 1M tokens, input plus output (A16),
    as exact decimals; NULL for an unlisted model.  A (service, model) that
    the list holds twice fails the job: neither price would be right."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated entry in the price list")))
    price = lambda c: F.coalesce(once, F.max(F.col(c).cast("decimal(12,6)"))).alias(c)
    pr = pricing.groupBy("service", "model").agg(price("input"), price("output"))
    # The list is a config document of some dozen entries: one map value, so
    # that calls of any number and of one model alone are priced where they lie.
    entries = F.collect_list(F.struct(F.struct("service", "model"), F.struct("input", "output")))
    prices = pr.agg(F.map_from_entries(entries).alias("prices")).scalar()
    of_call = F.try_element_at(prices, F.struct("service", "model"))
    per_token = F.lit(Decimal("0.000001"))
    cost = (F.col("input_tokens").cast("decimal(20,0)") * (of_call["input"] * per_token)
            + F.col("output_tokens").cast("decimal(20,0)") * (of_call["output"] * per_token))
    return calls.select("*", cost.alias("cost"))


# What the model is asked about each data set.
STEMS = {
    "author-commits-summary": "Describe how the work is spread over the authors, from these rows of commits by author:",
    "file-commit-count-summary": "Describe which files change most, from these rows of commits by file:",
    "commit-count-by-date-summary": "Describe how activity changes over time, from these rows of commits by date:",
    "churn-summary": "Describe where code is rewritten most, from these nodes of the churn tree:",
    "overall-tags-summary": "Describe what kinds of work are done, from these rows of tag totals:",
    "tags-by-week-summary": "Describe how the kinds of work shift, from these weekly tag shares:",
}
DEFAULT_STEM = "Describe what this data set shows:"


def summarise_datasets(datasets: dict, spans: DataFrame, existing: DataFrame | None, completer,
                       cache_path: str, ai_model: str = "offline|extractive",
                       created_at: str | None = None, max_tokens: int = 8000) -> DataFrame:
    """Summaries of data sets (L8, U6): each data set's content key per
    repository; data sets whose (repo, name, key) is stored already are
    skipped; of the rest every row goes to the completer as JSON, in blocks
    of ``max_tokens``, whose answers are combined level by level (R6) into
    one paragraph, with the repository's date span (A15).
    Output has the ``summaries`` schema."""
    from .load import lines_fingerprint, save_summary_if_new
    from .retrieve import tree_summarise
    lines = None
    for name, ds in datasets.items():
        rows = ds.select(*REPO, F.lit(name).alias("name"),
                         F.to_json(F.struct(*[c for c in ds.columns if c not in REPO])).alias("line"))
        lines = rows if lines is None else lines.unionByName(rows)
    # computed once: the keys, the levels' packing and the calls read the lines
    lines = cut_lineage(lines)
    cand = lines_fingerprint(lines, [*REPO, "name"], "line")
    if existing is not None:
        cand = save_summary_if_new(existing, cand)
    service, model = ai_model.split("|", 1)
    group = [*REPO, "name", "hash"]
    lines = lines.join(cand.select(*group), [*REPO, "name"])
    stem = F.lit(DEFAULT_STEM)
    for name, text in STEMS.items():
        stem = F.when(F.col("name") == name, F.lit(text)).otherwise(stem)
    out = tree_summarise(lines, group, "line", "line", completer, cache_path, fan_in=100_000,
                         model=ai_model, max_tokens=max_tokens, stem=stem)
    when = F.lit(created_at).cast("timestamp_ntz") if created_at else F.localtimestamp()
    return (out.join(spans.select(*REPO, F.col("first_date").alias("start_date"),
                                  F.col("last_date").alias("end_date")), list(REPO), "left")
            .select(*REPO, "name", "hash", "summary", F.lit(service).alias("ai_service"),
                    F.lit(model).alias("ai_model"), "start_date", "end_date",
                    when.alias("created_at")))


# ---------------------------------------------------------------------------
# Deterministic offline completers (picklable, no network).

class ExtractiveCompleter:
    """Answers with ``words`` words taken evenly from the whole prompt (all
    of them in a shorter one): a stand-in summariser that reads its input to
    the end and leaves out no line by rule."""

    def __init__(self, words: int = 40, prefix: str = ""):
        self.words, self.prefix = words, prefix

    def __call__(self, prompts):
        out = []
        for p in prompts:
            w = p.split()
            n = min(self.words, len(w))
            out.append(self.prefix + " ".join(w[i * len(w) // n] for i in range(n)))
        return out


class KeywordTagger:
    """Answers ``Name,weight,...`` by counting tag-name keywords in the
    prompt (case-insensitive); ``Other,1`` style unknown names are left to
    the parser to drop."""

    def __init__(self, tags):
        self.tags = list(tags)

    def __call__(self, prompts):
        out = []
        for p in prompts:
            low = p.rsplit("Description:", 1)[-1].lower()
            pairs = [f"{t},{low.count(t.lower())}" for t in self.tags if low.count(t.lower())]
            out.append(",".join(pairs) if pairs else "Other,1")
        return out


class Router:
    """Picks one of the tool names by overlap of the question's words (4+
    letters) with each tool description; ties go to the earlier tool."""

    def __init__(self, tools: dict[str, str]):
        self.tools = tools

    @staticmethod
    def _words(t: str) -> set[str]:
        return {w for w in re.findall(r"\w+", t.lower()) if len(w) >= 4}

    def __call__(self, prompts):
        out = []
        names = list(self.tools)
        for p in prompts:
            q = self._words(p.rsplit("Question:", 1)[-1])
            score = [len(q & self._words(self.tools[t])) for t in names]
            out.append(names[score.index(max(score))])
        return out
