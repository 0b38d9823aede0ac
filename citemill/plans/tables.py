"""Access to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue() -> tuple:
    """(queries, sql, decorator): the decorator enters a function under its name, with its SQL if there is one."""
    queries: dict = {}
    sql: dict = {}

    def register(text: str | None = None):
        def enter(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return enter

    return queries, sql, register
