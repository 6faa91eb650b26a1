"""All queries of the engine by name, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import graph, question, retrieval, state, text

_ALL = text.Q | retrieval.Q | graph.Q | question.Q | state.Q


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
