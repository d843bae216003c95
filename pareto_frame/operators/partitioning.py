"""Ways to lay rows out before a local pass.

Each of them is a shuffle; the plans run one local pass before it, so only the
partial skylines move. Ranges include all dimensions after the leading key: one
key value that holds a large share of the rows is then cut into several ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pareto_frame.session import default_partitions

#: Rows worth a task of their own, where small pieces of a table are numbered or written.
TASK_ROWS = 1 << 18


def by_first_dimension(df: DataFrame, dims: Sequence[str], n: int) -> DataFrame:
    """Range slices on the first dimension, sorted inside each slice."""
    return df.repartitionByRange(n, *dims).sortWithinPartitions(*dims)


def lexicographic(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Total order in which every row comes after its dominators."""
    return df.orderBy(*[F.col(c).asc() for c in dims])


def spread(df: DataFrame, dims: Sequence[str], n: int) -> DataFrame:
    """Balanced partitions without meaning; copies of a tuple meet in one."""
    return df.repartition(n, *dims)


def by_key(df: DataFrame, key: Column, dims: Sequence[str], n: int) -> DataFrame:
    """Neighbouring keys together, large keys cut along the dimensions."""
    return df.repartitionByRange(n, key, *dims)


def tasks_for(df: DataFrame, rows: int, pieces: int) -> int:
    """Tasks for ``pieces`` of ``rows`` rows in all: one each, as long as these are not many more than worth it."""
    return min(pieces, max(default_partitions(df), ceil(rows / TASK_ROWS)))


def piece(rows: int) -> Column:
    """Number of the run of ``rows`` neighbours within a partition; numbers rise from partition to partition."""
    place = F.monotonically_increasing_id()
    within = place.bitwiseAND(F.lit((1 << 33) - 1))
    return place - within + F.floor(within / F.lit(rows))
