"""Rows in memory and named views."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def points_schema(first: Sequence) -> T.StructType:
    """Positional columns ``x0, x1, ...`` typed after the first row.

    Integers and floats are dimensions (64 bits each, so that distinct values
    stay distinct); text is carried as text.
    """
    fields = []
    for i, value in enumerate(first):
        if isinstance(value, str):
            dtype: T.DataType = T.StringType()
        elif isinstance(value, int):
            dtype = T.LongType()
        else:
            dtype = T.DoubleType()
        fields.append(T.StructField(f"x{i}", dtype))
    return T.StructType(fields)


def from_rows(
    spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str | None = None
) -> DataFrame:
    """A DataFrame of rows that the caller already holds in memory."""
    return spark.createDataFrame(rows, schema or points_schema(rows[0]))


@contextmanager
def named_view(df: DataFrame, prefix: str = "points") -> Iterator[str]:
    """Register ``df`` under a fresh view name for SQL, and drop it afterwards."""
    name = f"{prefix}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)
