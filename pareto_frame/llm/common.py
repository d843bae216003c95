"""Helpers shared by the operators: stored intermediate tables and let-bound expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pareto_frame.session import scratch_path

#: A join side of at most this many narrow rows (ids, keys) is broadcast; above, it is shuffled.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Stored:
    """A table written to the shared folder and its exact number of rows."""

    rows: DataFrame
    count: int


def stored(df: DataFrame, label: str) -> Stored:
    """Write ``df`` as Parquet to the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), int(seen.get["n"]))


def maybe_broadcast(side: Stored, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if its counted size allows it."""
    return F.broadcast(side.rows) if side.count <= limit else side.rows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also when ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
