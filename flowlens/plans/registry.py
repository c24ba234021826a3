"""Registered queries: a Spark callable per name, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(column) -> Column:
    """Six decimals, with -0.0 folded into 0.0."""
    return F.round(column, 6) + F.lit(0.0)


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def round_sql(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"
