"""Per-function code metrics and the composite complexity score
(M1-M13, A13, A14, J7).

Extraction parses each source file with Python's ``ast`` inside
``mapInPandas`` (one file per row, files spread over tasks by Spark);
everything after extraction -- maxima, composite, per-file means -- is
relational.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import REPO
from ..plans.helpers import spread
from ..schemas import FUNCTIONS, TOP_LEVEL

# Weights of the composite score, in the order
# cyclomatic, lines, nesting, calls, variables, readability.
W_CC, W_LOC, W_DEPTH, W_CALLS, W_VARS, W_READ = 0.2, 0.15, 0.15, 0.15, 0.15, 0.2
# Fixed value: readability when the model's answer is not a number.
DEFAULT_READABILITY = 0.5

_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.Match, ast.match_case)
_BRANCH = _BRANCH + ((ast.TryStar,) if hasattr(ast, "TryStar") else ())
_NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Match)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _lines(source: str) -> list[bytes]:
    """Lines as the parser counts them: form feeds and other Unicode line
    separators do not end a line."""
    return [ln.encode("utf-8", "surrogatepass") for ln in _LINE.findall(source)]


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")


def _segment(lines: list[bytes], node) -> str:
    """Source text of ``node``.  The parser's columns count UTF-8 bytes, so
    the encoded lines are sliced (D5)."""
    s, e = node.lineno - 1, node.end_lineno - 1
    if s == e:
        part = lines[s][node.col_offset:node.end_col_offset]
    else:
        part = b"".join([lines[s][node.col_offset:], *lines[s + 1:e], lines[e][:node.end_col_offset]])
    return part.decode("utf-8", "replace")


def _children(node):
    for name in node._fields:
        v = getattr(node, name, None)
        if isinstance(v, ast.AST):
            yield v
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, ast.AST):
                    yield x


def _location(lines: list[bytes], node) -> dict:
    """Lines from 1, columns in characters."""
    def column(line, offset):
        return len(lines[line - 1][:offset].decode("utf-8", "replace"))
    return {"start": {"line": node.lineno, "character": column(node.lineno, node.col_offset)},
            "end": {"line": node.end_lineno, "character": column(node.end_lineno, node.end_col_offset)}}


def _parse(source: str):
    """(tree, reason it cannot be parsed): also too deep nesting."""
    try:
        return ast.parse(source), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, f"{type(e).__name__}: {e}"[:200]


def _comments(source: str) -> list[tuple[int, str]]:
    """(line, text) of every comment, trailing ones too; none inside strings."""
    try:
        return [(t.start[0], t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline)
                if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return []


_VARS = (ast.Name, ast.arg, ast.Assign, ast.AnnAssign, ast.AugAssign)


def parse_definitions(file_path: str, source: str) -> list[dict]:
    """Every function (nested ones too, each its own row) and class of one
    Python file (M1-M7, M9, M10).  Unparsable files give no rows.

    One pre-order pass over the module; each node updates the counters of
    every function that encloses it, at its depth below that function:
    cyclomatic = 1 + branch nodes (if/for/while/try/match/case), nesting =
    max over control nodes of (depth + 1), control depth = max number of
    control nodes on a path, variables = names, parameters and assignments,
    calls = callee text in pre-order, imports inside the function."""
    tree, _ = _parse(source)
    if tree is None:
        return []
    lines, comments = _lines(source), _comments(source)
    out = []
    # stack items: (node, ((ctx, depth below ctx's function, control depth), ...))
    stack = [(tree, ())]
    while stack:
        node, enc = stack.pop()
        if enc:
            is_branch = isinstance(node, _BRANCH)
            is_nest = isinstance(node, _NEST)
            is_var = isinstance(node, _VARS)
            call = _segment(lines, node.func) if isinstance(node, ast.Call) else None
            imp = _segment(lines, node) if isinstance(node, ast.Import) else None
            for ctx, d, cd in enc:
                if is_branch:
                    ctx["cyclomatic_complexity"] += 1
                if is_nest and d + 1 > ctx["nesting_depth"]:
                    ctx["nesting_depth"] = d + 1
                if cd > ctx["control_depth"]:
                    ctx["control_depth"] = cd
                if is_var:
                    ctx["number_of_variables"] += 1
                if call is not None:
                    ctx["calls"].append(call)
                if imp is not None and d:
                    ctx["imports"].append(imp)
        if isinstance(node, _DEFS):
            code = _segment(lines, node)
            ctx = dict(file_path=file_path, type="function", name=node.name, code=code,
                       lines_of_code=len(_LINE.findall(code)), cyclomatic_complexity=1,
                       nesting_depth=0, control_depth=0, number_of_variables=0,
                       calls=[], imports=[], docstring=ast.get_docstring(node),
                       comments=[c for n, c in comments if node.lineno <= n <= node.end_lineno],
                       location=_location(lines, node))
            out.append(ctx)
            enc = enc + ((ctx, 0, 0),)
        elif isinstance(node, ast.ClassDef):
            code = _segment(lines, node)
            out.append(dict(file_path=file_path, type="class", name=node.name, code=code,
                            lines_of_code=len(_LINE.findall(code)), calls=[], imports=[],
                            comments=[], docstring=ast.get_docstring(node),
                            location=_location(lines, node)))
        for ch in reversed(list(_children(node))):
            nest = isinstance(ch, _NEST)
            stack.append((ch, tuple((c, d + 1, cd + (1 if nest else 0)) for c, d, cd in enc)))
    for ctx in out:
        if ctx["type"] == "function":
            ctx["number_of_function_calls"] = len(ctx["calls"])
    return out


def parse_top_level(file_path: str, source: str) -> dict:
    """Imports anywhere in the file (``import`` and ``from``) and statements
    outside definitions, de-duplicated, imports excluded (M7, M8)."""
    tree, _ = _parse(source)
    if tree is None:
        return dict(file_path=file_path, imports=[], code=[])
    lines = _lines(source)
    imports = [_segment(lines, n).strip() for n in ast.walk(tree)
               if isinstance(n, (ast.Import, ast.ImportFrom))]
    code, seen = [], set(imports) | {""}

    def visit(body):
        for st in body:
            if isinstance(st, _DEFS + (ast.Import, ast.ImportFrom)):
                continue
            if isinstance(st, ast.ClassDef):
                visit(st.body)
                continue
            seg = _segment(lines, st).strip()
            if seg not in seen:
                seen.add(seg)
                code.append(seg)
    visit(tree.body)
    return dict(file_path=file_path, imports=imports, code=code)


def unparsable(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """The files that M1 gives no rows for, with the reason."""
    schema = "repo_owner string, repo_name string, file_path string, reason string"

    def run(batches):
        for pdf in batches:
            rows = [(o, r, p, _parse(src)[1]) for o, r, p, src
                    in zip(pdf["repo_owner"], pdf["repo_name"], pdf[path], pdf[text]) if src is not None]
            yield pd.DataFrame([x for x in rows if x[3]], columns=["repo_owner", "repo_name", "file_path", "reason"])

    return files.select(*REPO, path, text).mapInPandas(run, schema)


def _ext(path: str) -> str:
    leaf = path.rsplit("/", 1)[-1]
    body = leaf.lstrip(".")
    return "." + body.rsplit(".", 1)[-1] if "." in body else ""


def extract_functions(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """Definitions of every Python file of ``files`` (repo, path, text) (M1)."""
    cols = [f.name for f in FUNCTIONS.fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for ro, rn, p, src in zip(pdf["repo_owner"], pdf["repo_name"], pdf[path], pdf[text]):
                if src is None:
                    continue
                for d in parse_definitions(p, src):
                    d["repo_owner"], d["repo_name"] = ro, rn
                    rows.append(d)
            yield pd.DataFrame(rows, columns=cols)

    return spread(files.select(*REPO, path, text), path).mapInPandas(run, FUNCTIONS)


def extract_top_level(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """Top-level imports and statements per file (M7, M8, S10 repo map)."""
    cols = [f.name for f in TOP_LEVEL.fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for ro, rn, p, src in zip(pdf["repo_owner"], pdf["repo_name"], pdf[path], pdf[text]):
                d = parse_top_level(p, src or "")
                d.update(repo_owner=ro, repo_name=rn, file_extension=_ext(p))
                rows.append(d)
            yield pd.DataFrame(rows, columns=cols)

    return spread(files.select(*REPO, path, text), path).mapInPandas(run, TOP_LEVEL)


def readability(answer) -> "F.Column":
    """Model answer as a float, 0.5 when it is not one."""
    a = F.col(answer) if isinstance(answer, str) else answer
    return F.coalesce(F.trim(a).try_cast("double"), F.lit(DEFAULT_READABILITY))


_METRICS = [("cyclomatic_complexity", "max_cc"), ("lines_of_code", "max_loc"),
            ("nesting_depth", "max_depth"), ("number_of_function_calls", "max_calls"),
            ("number_of_variables", "max_vars")]


def metric_maxima(functions: DataFrame) -> DataFrame:
    """Per repository, the maxima of five metrics over functions."""
    f = functions.filter(F.col("type") == "function")
    return f.groupBy(*REPO).agg(*[F.max(c).alias(m) for c, m in _METRICS])


def composite_complexity(functions: DataFrame, readability_col: str = "llm_code_readability") -> DataFrame:
    """Composite score per function (M11, J7): weighted metric / repository
    maximum (0 when the maximum is 0) plus weighted readability; NULL for
    classes.  The maxima are one row per repository, joined back (broadcast
    after a size check) -- no window holds a whole repository."""
    mx = metric_maxima(functions)
    j = functions.join(mx, list(REPO), "left")

    def ratio(c, m):
        return F.when(F.col(m) > 0, F.col(c).cast("double") / F.col(m).cast("double")).otherwise(F.lit(0.0))

    score = (F.lit(W_CC) * ratio("cyclomatic_complexity", "max_cc")
             + F.lit(W_LOC) * ratio("lines_of_code", "max_loc")
             + F.lit(W_DEPTH) * ratio("nesting_depth", "max_depth")
             + F.lit(W_CALLS) * ratio("number_of_function_calls", "max_calls")
             + F.lit(W_VARS) * ratio("number_of_variables", "max_vars")
             + F.lit(W_READ) * F.col(readability_col).cast("double"))
    return (j.withColumn("composite_complexity",
                         F.when(F.col("type") == "function", score))
            .drop(*[m for _, m in _METRICS]))


def _mean_complexity() -> tuple:
    """Mean composite over the functions with composite > 0, 0 when there are
    none: an exact decimal sum over a count."""
    pos = F.when(F.col("composite_complexity") > 0, F.col("composite_complexity").cast("decimal(18,9)"))
    mean = F.when(F.col("_n") > 0, F.col("_s").cast("double") / F.col("_n").cast("double")).otherwise(F.lit(0.0))
    return [F.sum(pos).alias("_s"), F.count(pos).alias("_n")], mean.cast("decimal(18,4)").alias("avg_complexity")


def file_complexity(scored: DataFrame, path: str = "file_path") -> DataFrame:
    """Mean composite per file (A13, O5 order by the caller)."""
    parts, mean = _mean_complexity()
    return scored.groupBy(*REPO, path).agg(*parts).select(*REPO, F.col(path).alias("file_path"), mean)


def file_metrics(scored: DataFrame, path: str = "file_path") -> DataFrame:
    """Per-file document: mean complexity plus the nested function list (M13),
    in one aggregate.  A file's list is bounded by its definitions."""
    fn = F.struct(F.col("name").alias("function_name"), "composite_complexity",
                  "lines_of_code", "cyclomatic_complexity", "nesting_depth",
                  "number_of_variables", "number_of_function_calls")
    parts, mean = _mean_complexity()
    return (scored.groupBy(*REPO, path).agg(*parts, F.array_sort(F.collect_list(fn)).alias("functions"))
            .select(*REPO, F.col(path).alias("file_path"), mean, "functions"))
