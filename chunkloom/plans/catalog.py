"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its own name or the one given."""

    def register(function: QueryFunction) -> QueryFunction:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function

    return register


def load() -> None:
    from chunkloom.plans import (  # noqa: F401
        corpus_queries,
        conversation_queries,
        metric_queries,
        retrieval_queries,
        stream_queries,
        task_queries,
        training_queries,
    )
