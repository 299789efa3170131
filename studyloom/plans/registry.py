"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from studyloom.plans import data_queries, job_queries, profile_queries, retrieval_queries, text_queries, tool_queries

_MODULES = (profile_queries, text_queries, retrieval_queries, job_queries, data_queries, tool_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
