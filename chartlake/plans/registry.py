"""Registry of the named queries exposed through ``__spark_entry__``: each key maps to a
Spark builder ``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, an oracle
SQL string over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from chartlake.plans import (  # noqa: F401
        q_charts,
        q_runs,
        q_text,
        q_guards,
        q_files,
        q_io,
        q_misc,
        q_stream,
    )
