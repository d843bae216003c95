from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under its inventory id, with its SQL where SQL can state it."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# SQL text helpers


def dominates(q: list[str], p: list[str]) -> str:
    weak = " AND ".join(f"{a} <= {b}" for a, b in zip(q, p, strict=True))
    better = " OR ".join(f"{a} < {b}" for a, b in zip(q, p, strict=True))
    return f"{weak} AND ({better})"


def not_exists(source: str, dims: list[str], rivals: str | None = None) -> str:
    """WHERE condition: no row of ``rivals`` dominates the row ``p``."""
    test = dominates([f"q.{d}" for d in dims], [f"p.{d}" for d in dims])
    return f"NOT EXISTS (SELECT 1 FROM {rivals or source} q WHERE {test})"
