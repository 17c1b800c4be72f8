"""Registered queries: a Spark function and, where SQL can say it, its SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def load() -> None:
    from trajmill.registry import (  # noqa: F401
        expansions,
        metric_queries,
        problem_queries,
        selections,
        storage,
        texts,
        verifier_queries,
    )
