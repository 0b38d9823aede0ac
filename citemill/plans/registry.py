"""Registered queries over the given tables, with the SQL (DuckDB) that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, evaluation_queries, report_queries, search_queries, text_queries

_MODULES = (search_queries, evaluation_queries, text_queries, answer_queries, report_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
