"""Registry of the core queries: what each computes, and its DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def joined(df: DataFrame, column: str, by: str = "|") -> DataFrame:
    """``df`` with an array as one text: results of queries are flat, so that any tool can compare them."""
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), by))


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
