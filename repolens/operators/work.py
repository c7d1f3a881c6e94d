"""The describe chain as a work table (L2-L4, U3): every undescribed change of
a code file goes from ``todo`` to ``described`` or ``rejected``, and the
descriptions are written back by key.

Rows of the same file name, data and state are one task.  A round asks for all
open tasks at once (one call per distinct prompt, through the store) and takes
each to its next state; finished tasks leave the table and are not touched
again.  At the end the rows, which keep only their keys meanwhile, are joined
to their tasks.

====== ===========================================================
state   next
====== ===========================================================
todo    asked to describe its diff, or its content where there is
        no diff; no usable answer: tried again, at most
        ``max_attempts`` times, then rejected; an answer that is
        too long: long; else described
long    asked to shorten its text; at most ``rounds`` times, then
        rejected
====== ===========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import REPO
from ..functions.text import is_code_file
from ..session import cut_lineage
from .annotate import MAX_DESCRIPTION, SHORTEN_ROUNDS, SYSTEM, TEMPLATES, annotate, render
from .load import update_by_key

KEYS = [*REPO, "commit_hash", "filename"]
MAX_ATTEMPTS = 3


def describe_work(changes: DataFrame, sources: DataFrame) -> DataFrame:
    """The work table of the changes that have no description yet.
    ``sources``: repo, commit_hash, filename, diff, content (L2: the content
    counts only where there is no diff).  Columns: keys, source ('diff',
    'content' or NULL), data, text, state, attempts, tries, reason."""
    todo = changes.filter(F.col("description").isNull() & is_code_file("filename")).select(*KEYS)
    source = F.when(F.col("diff").isNotNull(), "diff").when(F.col("content").isNotNull(), "content")
    return todo.join(sources.select(*KEYS, "diff", "content"), KEYS, "left").select(
        *KEYS, source.alias("source"), F.coalesce("diff", "content").alias("data"), F.lit(None).cast("string").alias("text"),
        F.when(source.isNull(), "rejected").otherwise("todo").alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("tries"),
        F.when(source.isNull(), "no diff and no content").alias("reason"))


def _advance(asked: DataFrame, max_len: int, max_attempts: int, rounds: int) -> DataFrame:
    """The next state of each row, from its answer ``_answer``."""
    fresh, answer = F.col("state") == "todo", F.col("_answer")
    short = F.length(F.trim(answer)) <= max_len
    attempts = F.col("attempts") + F.when(fresh & answer.isNull(), 1).otherwise(0)
    tries = F.col("tries") + F.when(fresh, 0).otherwise(1)
    state = (F.when(short, "described")
             .when(fresh, F.when(answer.isNotNull(), "long").when(attempts >= max_attempts, "rejected").otherwise("todo"))
             .when(tries >= rounds, "rejected").otherwise("long"))
    reason = F.when(state == "rejected", F.when(fresh, "no usable answer").otherwise("never short enough"))
    return asked.select("_task", "filename", "source", "data", F.coalesce(answer, "text").alias("text"), state.alias("state"),
                        attempts.alias("attempts"), tries.alias("tries"), reason.alias("reason"))


def run_work(work: DataFrame, completer, cache_path: str, model: str = "offline", max_len: int = MAX_DESCRIPTION,
             max_attempts: int = MAX_ATTEMPTS, rounds: int = SHORTEN_ROUNDS, with_system: bool = False) -> DataFrame:
    """The work table with every row described or rejected.  ``with_system``
    gives the completer the system prompt of each row's task, too (L1)."""
    is_open = F.col("state").isin("todo", "long")
    told = [c for c in work.columns if c not in KEYS]
    # to_json leaves nulls out, so that they differ from empty texts
    rows = cut_lineage(work.withColumn("_task", F.when(is_open, F.unhex(F.sha2(F.to_json(F.struct("filename", *told)), 256)))))
    tasks = rows.filter("_task is not null").select("_task", "filename", *told)
    open_, done = cut_lineage(tasks.groupBy("_task").agg(*[F.first(c).alias(c) for c in tasks.columns[1:]])), None
    clause = F.when(F.col("source") == "diff", "Unified Diff:").otherwise("File Content:")
    describe = render(TEMPLATES["summarize_diff"], filename="filename", clause=clause, data="data")
    shorten = render(TEMPLATES["shorter_summarize_diff"], filename="filename", long_summary="text")
    prompt = F.when(F.col("state") == "todo", describe).otherwise(shorten)
    system = F.when(F.col("state") == "todo", SYSTEM["summarize_diff"]).otherwise(SYSTEM["shorter_summarize_diff"]) if with_system else None
    # Each round an open row spends an attempt or a try, or it is done.
    for _ in range(max_attempts + rounds):
        if open_.isEmpty():
            break
        asked = annotate(open_, prompt, completer, cache_path, model, out="_answer", system=system)
        after = cut_lineage(_advance(asked, max_len, max_attempts, rounds))
        ended = after.filter(~is_open)
        done = ended if done is None else done.unionByName(ended)
        open_ = after.filter(is_open)
    ends = (open_ if done is None else done.unionByName(open_)).drop("filename")
    return (rows.filter("_task is null").select(*work.columns)
            .unionByName(rows.filter("_task is not null").select("_task", *KEYS).join(ends, "_task").select(*work.columns)))


def write_back(changes: DataFrame, work: DataFrame) -> DataFrame:
    """``changes`` with the descriptions of the described rows."""
    got = work.filter("state = 'described'").select(*KEYS, F.trim("text").alias("description"))
    return update_by_key(changes, got, KEYS, ["description"])
