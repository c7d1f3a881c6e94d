"""Registered code-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import REPO
from ..operators import code_metrics as M
from ..sources import fixtures as X
from .registry import query
from ..session import scratch_path
import uuid

FN = X.sql_with(X.SQL_FUNCTIONS)

_SCORED = FN + """, mx as (
  select repo_owner, repo_name, max(cyclomatic_complexity) as max_cc, max(lines_of_code) as max_loc,
    max(nesting_depth) as max_depth, max(number_of_function_calls) as max_calls,
    max(number_of_variables) as max_vars
  from functions where type = 'function' group by 1, 2),
scored as (
  select f.*, case when f.type = 'function' then
      0.2::double * (case when max_cc > 0 then cast(cyclomatic_complexity as double) / cast(max_cc as double) else 0.0 end)
    + 0.15::double * (case when max_loc > 0 then cast(lines_of_code as double) / cast(max_loc as double) else 0.0 end)
    + 0.15::double * (case when max_depth > 0 then cast(nesting_depth as double) / cast(max_depth as double) else 0.0 end)
    + 0.15::double * (case when max_calls > 0 then cast(number_of_function_calls as double) / cast(max_calls as double) else 0.0 end)
    + 0.15::double * (case when max_vars > 0 then cast(number_of_variables as double) / cast(max_vars as double) else 0.0 end)
    + 0.2::double * cast(llm_code_readability as double) end as composite_complexity
  from functions f left join mx on f.repo_owner = mx.repo_owner and f.repo_name = mx.repo_name)"""


def _scored(spark, sf):
    return M.composite_complexity(X.function_metrics(spark, sf))


@query("metric_maxima", FN + """select repo_owner, repo_name, max(cyclomatic_complexity) as max_cc,
  max(lines_of_code) as max_loc, max(nesting_depth) as max_depth,
  max(number_of_function_calls) as max_calls, max(number_of_variables) as max_vars
from functions where type = 'function' group by 1, 2""")
def q_metric_maxima(spark, sf):
    return M.metric_maxima(X.function_metrics(spark, sf))


@query("composite_complexity", _SCORED + """
select repo_owner, repo_name, file_path, name,
  cast(composite_complexity as decimal(18,4)) as composite_complexity from scored""")
def q_composite_complexity(spark, sf):
    return _scored(spark, sf).select(
        *REPO, "file_path", "name",
        F.col("composite_complexity").cast("decimal(18,4)").alias("composite_complexity"))


@query("file_complexity", _SCORED + """,
pos as (select *, case when composite_complexity > 0 then cast(composite_complexity as decimal(18,9)) end as p
        from scored)
select repo_owner, repo_name, file_path,
  cast(case when count(p) > 0 then cast(sum(p) as double) / cast(count(p) as double) else 0.0 end
    as decimal(18,4)) as avg_complexity
from pos group by 1, 2, 3""")
def q_file_complexity(spark, sf):
    return M.file_complexity(_scored(spark, sf))


# The sources that ``fixtures.part_source_files`` generates and what the parser
# finds in them: functions of two shapes, with the metrics of each.
SQL_PARSED = f"""parsed as (
  select 'tpch' as repo_owner, concat('mfgr', substr(p_brand, 7, 1)) as repo_name,
    concat('src/', replace(lower(p_brand), '#', '_'), '/mod_', p_partkey // {X.FUNCTIONS_PER_FILE}, '.py') as file_path, 'function' as type,
    concat('f_', regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_', p_partkey) as name, p_name as docstring,
    concat('def ', 'f_', regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_', p_partkey, '(x):', chr(10), '    \"\"\"', p_name, '\"\"\"', chr(10),
      '    total = ', p_size, chr(10), '    if x > ', p_size, ':', chr(10), '        total = total + scale(x)', chr(10),
      case when p_partkey % 2 = 0 then concat('    for i in range(x):', chr(10), '        if i % ', p_partkey % 7 + 2, ' == 0:', chr(10),
        '            total += step(i)', chr(10)) else '' end, '    return total') as code,
    case when p_partkey % 2 = 0 then 9 else 6 end as lines_of_code, case when p_partkey % 2 = 0 then 4 else 2 end as cyclomatic_complexity,
    case when p_partkey % 2 = 0 then 3 else 2 end as nesting_depth, case when p_partkey % 2 = 0 then 18 else 10 end as number_of_variables,
    case when p_partkey % 2 = 0 then 3 else 1 end as number_of_function_calls
  from part)"""


def scored_sql(readability: str) -> str:
    """``_SCORED`` over the parsed functions, with their readability."""
    functions = f"functions as (select *, {readability} as llm_code_readability from parsed)"
    return "with " + SQL_PARSED + ",\n" + functions + _SCORED[len(FN):]


def _parsed(spark, sf):
    # the parsed functions table is written once (like the repo map) and
    # read by both the maxima and the per-row scoring branches
    path = scratch_path(spark, f"functions-{uuid.uuid4().hex}")
    M.extract_functions(X.part_source_files(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


@query("source_functions")
def q_source_functions(spark, sf):
    """M1-M10 end to end: parse the generated sources, one row per
    definition with its metrics (no SQL oracle: a parser; unit tests check
    it against hand-computed values)."""
    fns = M.extract_functions(X.part_source_files(spark, sf))
    return fns.select(*REPO, "file_path", "type", "name", "lines_of_code",
                      "cyclomatic_complexity", "nesting_depth", "control_depth",
                      "number_of_variables", "number_of_function_calls", "calls", "location")


@query("source_file_complexity", scored_sql("cast(length(docstring) % 10 as double) / 10") + """,
pos as (select *, case when composite_complexity > 0 then cast(composite_complexity as decimal(18,9)) end as p from scored)
select repo_owner, repo_name, file_path,
  cast(case when count(p) > 0 then cast(sum(p) as double) / cast(count(p) as double) else 0.0 end as decimal(18,4)) as avg_complexity,
  cast(count(*) as int) as n_functions
from pos group by 1, 2, 3""")
def q_source_file_complexity(spark, sf):
    """M1 -> M11 -> M13: parsed functions scored against repository maxima
    (readability from the docstring length as a stand-in model answer) and
    folded into per-file documents."""
    fns = _parsed(spark, sf)
    fns = fns.withColumn("llm_code_readability",
                         M.readability((F.length("docstring") % 10 / 10).cast("string")))
    return M.file_metrics(M.composite_complexity(fns)).select(
        *REPO, "file_path", "avg_complexity", F.size("functions").alias("n_functions"))


@query("source_top_level", "with " + SQL_PARSED + """
select distinct repo_owner, repo_name, file_path, '.py' as file_extension, ['import math', 'from os import path'] as imports, ['LIMIT = 10'] as code
from parsed""")
def q_source_top_level(spark, sf):
    """M7/M8: file-level imports and statements outside definitions."""
    return M.extract_top_level(X.part_source_files(spark, sf))
