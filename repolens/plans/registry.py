"""Named queries over the driver's tables, each with its SQL oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle is DuckDB SQL over
the base tables (views in CTEs).  Queries whose result is not expressible in
SQL (model calls, parsers) register without an oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL text."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (queries_activity, queries_code, queries_load, queries_pulls,  # noqa: F401
                   queries_more, queries_retrieval, queries_sources, queries_tags, queries_text,
                   queries_rollup, queries_runs, queries_trees)
