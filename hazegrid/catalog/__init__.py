"""Registered queries over the driver's tables, each next to its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.functions.names import named

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(named(c), n) for c, n in digits.items()})


def register(name: str, sql: str | None = None, digits: dict[str, int] | str | None = None):
    """Register a query with its oracle.

    ``digits`` rounds floating columns on both sides, since the engines add in
    different orders. A string lists columns: sums get six digits, others nine.
    """
    if isinstance(digits, str):
        names = [c.strip() for c in digits.split(",")]
        digits = {c: 6 if c == "sum" else 9 for c in names}

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return rounded(df, digits) if digits else df

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            body = sql
            if digits:
                parts = ", ".join(f'round("{c}", {n}) AS "{c}"' for c, n in digits.items())
                body = f"SELECT * REPLACE ({parts}) FROM ({sql}) AS q"
            ORACLES[name] = body
        return fn

    return add


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every catalog module and return queries and oracles."""
    from hazegrid.catalog import (  # noqa: F401
        aggs,
        exprs,
        features,
        io,
        jobs,
        joins,
        profiles,
        rows,
        streams,
    )

    return QUERIES, ORACLES
