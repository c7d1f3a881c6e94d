"""Chat formatting into windows of a token budget, with DataFrame functions only.

Template: ``<|turn|>role<|says|>text<|end|>`` and a line feed per turn.  Inside roles and texts, a ``<`` that a ``|`` follows,
with any number of backslashes between, gets one backslash more; taking one away again gives back the same string, and
no control string can come from a text.

Windows hold whole turns.  The prefix sums of the turns' tokens fall on a grid of ``budget - history - system`` tokens:
the turns that lie inside one cell are a window, and a turn that crosses into the next cell is a window of its own.  So
only a single turn that is larger than a cell can exceed the budget.  Each window starts with the conversation's system
turn (its first, if its role is system) and repeats the turns before it, up to ``history`` tokens.  The loss mask covers the
assistant texts of a window's own turns, never those of repeated turns: each assistant text counts in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
BUDGET, HISTORY = 256, 64


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\\\|", r"<$1|")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, window (from 1), text, new_from (characters before the window's own turns), loss (array of start and length
    in characters, from 0).

    A turn's tokens are a quarter of its formatted characters, rounded up.  A null role or text is empty; turns of equal
    number are ordered by role and text, and a null number comes first; repeated rows are turns each; a null conversation
    id is one conversation; an empty table gives no windows; other columns are not read.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("pos"), F.count("*").over(conv).alias("n"),
                 F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(SAYS)).alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("shown", F.concat("head", "body", F.lit(END + "\n")))
    t = t.withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system") & (F.col("n") > 1))
    t = t.withColumn("tokens", F.when(F.col("is_system"), 0).otherwise(F.ceil(F.length("shown") / 4)).cast("long"))
    t = t.withColumn("system", F.coalesce(F.first(F.when(F.col("is_system"), F.col("shown")), ignorenulls=True).over(conv), F.lit("")))
    t = t.withColumn("s", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    t = t.withColumn("c", F.coalesce(F.sum(F.when(F.col("is_system"), 0).otherwise(F.length("shown"))).over(before), F.lit(0)))
    grid = F.greatest(F.lit(budget - history) - F.ceil(F.length("system") / 4), F.lit(1))
    t = t.where(~F.col("is_system")).withColumn("cell", F.floor(F.col("s") / grid))
    t = t.withColumn("crosses", F.floor((F.col("s") + F.col("tokens") - 1) / grid) > F.col("cell"))
    # Every turn has a token at least, so a frame of ``history`` tokens holds as many turns at most.
    past = conv.orderBy("s").rangeBetween(-history, -1)
    t = t.withColumn("past", F.collect_list(F.struct("s", "shown")).over(past))
    w = t.groupBy("conv_id", "cell", "crosses").agg(
        F.array_sort(F.collect_list(F.struct("s", "c", "shown", F.length("head").alias("skip"), F.length("body").alias("size"),
                                             (F.col("role") == "assistant").alias("learn")))).alias("own"),
        F.min_by("past", "s").alias("past"), F.first("system").alias("system"))
    shown = lambda a: F.array_join(F.transform(a, lambda x: x["shown"]), "")
    w = w.withColumn("lead", F.concat("system", shown(F.array_sort("past")))).withColumn("new_from", F.length("lead"))
    w = w.withColumn("loss", F.transform(F.filter("own", lambda x: x["learn"]), lambda x: F.struct(
        (F.col("new_from") + x["c"] - F.col("own")[0]["c"] + x["skip"]).cast("long").alias("start"), x["size"].cast("long").alias("length"))))
    number = F.row_number().over(conv.orderBy("cell", "crosses"))
    return w.select("conv_id", number.alias("window"), F.concat("lead", shown(F.col("own"))).alias("text"),
                    F.col("new_from").cast("long").alias("new_from"), "loss", F.length("system").cast("long").alias("system_chars"))


def read_back(w: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role and text, unescaped, in order, each turn once), learned (the texts under the loss
    mask, unescaped) and formatted_chars, from the formatted windows alone."""
    first = F.col("window") == 1
    own = F.when(first, F.col("text")).otherwise(F.expr("substring(text, int(new_from) + 1)"))
    parts = F.split(own, r"<\|end\|>\n")  # never inside a text
    turns = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(
        unescape(F.substring_index(F.substring_index(x, BEGIN, -1), SAYS, 1)).alias("role"), unescape(F.substring_index(x, SAYS, -1)).alias("text")))
    learned = F.transform("loss", lambda x: unescape(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return w.select("conv_id", "window", turns.alias("turns"), learned.alias("learned"), F.length("text").cast("long").alias("formatted_chars"))


def digests(w: DataFrame) -> DataFrame:
    """One row per conversation, from what is read back.  A digest runs over all text of a conversation in order, so that
    text meets in one row: the size of a conversation is bounded by the size of a cell."""
    r = read_back(w).select(
        "conv_id", "window", F.size("turns").cast("long").alias("n"), "formatted_chars",
        F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("all"),
        F.array_join("learned", "").alias("learned"))
    parts = F.array_sort(F.collect_list(F.struct("window", "all", "learned")))
    g = r.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), parts.alias("parts"))
    whole = lambda name: F.array_join(F.transform("parts", lambda x: x[name]), "")
    return g.select("conv_id", "n_turns", F.sha2(whole("all").cast("binary"), 256).alias("turns_sha256"),
                    F.length(whole("learned")).cast("long").alias("loss_chars"), F.sha2(whole("learned").cast("binary"), 256).alias("loss_sha256"),
                    "formatted_chars")


#: The same digests straight from the turns, and the windows' sizes from the same prefix sums.
ORACLE_SQL = rf"""
with raw as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, count(*) over (partition by conv_id) as n,
    length('{BEGIN}{SAYS}{END}' || chr(10) || regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as chars
  from raw
), u as (
  select *, (pos = 1 and role = 'system' and n > 1) as is_system from t
), v as (
  select *, coalesce(max(case when is_system then chars end) over (partition by conv_id), 0) as sys,
    coalesce(sum(case when is_system then 0 else (chars + 3) // 4 end) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as s
  from u
), c as (
  select *, greatest({BUDGET - HISTORY} - (sys + 3) // 4, 1) as grid from v where not is_system
), d as (
  select *, s // grid as cell, (s + (chars + 3) // 4 - 1) // grid > s // grid as crosses,
    coalesce(sum(chars) over (partition by conv_id order by s range between {HISTORY} preceding and 1 preceding), 0) as past from c
), w as (
  select conv_id, cell, crosses, sum(chars) + min_by(past, s) + any_value(sys) as chars from d group by all
), f as (select conv_id, cast(sum(chars) as bigint) as formatted_chars from w group by conv_id)
select t.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256, any_value(formatted_chars) as formatted_chars
from t join f on t.conv_id is not distinct from f.conv_id group by t.conv_id
"""
