"""Query registry: every registered query takes ``(spark, sf_dir)`` and
returns a lazy DataFrame; most carry the equivalent DuckDB SQL as oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` = None means rows-only check."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every query module so they register themselves."""
    from . import (lexical_queries, length_queries, prep_queries,  # noqa: F401
                   profile_queries, scoring_queries, io_queries, ml_queries, model_queries,
                   level_queries)
