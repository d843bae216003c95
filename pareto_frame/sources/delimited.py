"""Delimited measurement files.

Both known layouts go through one cleaning order: pick measures by position,
drop duplicate rows, read numbers, drop incomplete rows. Duplicates are compared as a
reader that types whole columns sees them: a column in which every value is a number is
compared by number (``1.0`` equals ``1.00``), any other column by its text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareto_frame.operators.cleaning import (
    NUMBER,
    coerce_numeric,
    drop_duplicate_rows,
    drop_incomplete,
    keep_measures,
    quoted,
)


@dataclass(frozen=True)
class Layout:
    """Positions in the order in which they are given up, and the limits."""

    drop_order: Sequence[int]
    always_drop: int
    least: int
    most: int


# Column positions of the two measurement files.
SENSOR_FILE = Layout((0, 1, 12, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11), 3, 2, 10)
POWER_FILE = Layout((0, 1, 6, 7, 8, 2, 4), 2, 2, 7)


def read_text_columns(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """All columns as text; types are decided after cleaning."""
    return spark.read.option("sep", sep).option("header", True).csv(path)


def wholly_numeric(df: DataFrame) -> list[str]:
    """Text columns in which every value that is there is a number; one pass over the rows."""
    if not df.columns:
        return []
    unread = [
        F.max(quoted(c).isNotNull() & ~quoted(c).rlike(NUMBER)).alias(f"c{i}")
        for i, c in enumerate(df.columns)
    ]
    found = df.agg(*unread).first()
    return [c for i, c in enumerate(df.columns) if not found[i]]


def clean_measures(raw: DataFrame, layout: Layout, num_col: int = 4) -> DataFrame:
    picked = keep_measures(
        raw, num_col, layout.drop_order, layout.always_drop, layout.least, layout.most
    )
    numeric = wholly_numeric(picked)
    typed = coerce_numeric(picked, numeric) if numeric else picked
    return drop_incomplete(coerce_numeric(drop_duplicate_rows(typed)))


def load_sensor_file(spark: SparkSession, path: str, num_col: int = 4) -> DataFrame:
    return clean_measures(read_text_columns(spark, path), SENSOR_FILE, num_col)


def load_power_file(spark: SparkSession, path: str, num_col: int = 4) -> DataFrame:
    return clean_measures(read_text_columns(spark, path), POWER_FILE, num_col)
