"""Scalar geometry on tuples of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that bucket ids depend on.
TWO_OVER_PI = 0.636619772
ZERO_DIVISOR = 0.0001
HALF_OPEN_FACTOR = 0.999999

# Type of ids that a bigint cannot hold.
WIDE_ID = "decimal(38,0)"


def squared_norm(xs: Sequence[Column]) -> Column:
    return reduce(add, [x * x for x in xs])


def norm(xs: Sequence[Column]) -> Column:
    return F.sqrt(squared_norm(xs))


def angle_ratios(xs: Sequence[Column]) -> list[Column]:
    """Tangents of the d-1 hyperspherical angles.

    The i-th is the length of the coordinates after i over coordinate i, where
    that length is what is left of the squared norm, never below zero.
    """
    rest = squared_norm(xs)
    ratios = []
    for x in xs[:-1]:
        rest = F.greatest(F.lit(0.0), rest - x * x)
        ratios.append(F.sqrt(rest) / F.when(x == 0, F.lit(ZERO_DIVISOR)).otherwise(x))
    return ratios


def angles(xs: Sequence[Column]) -> list[Column]:
    return [F.atan(r) for r in angle_ratios(xs)]


def angular_digits(xs: Sequence[Column], slices: int) -> list[Column]:
    """Slice of each of the d-1 angles."""
    return [F.floor(a * F.lit(TWO_OVER_PI * slices)) for a in angles(xs)]


def angular_bucket(xs: Sequence[Column], slices: int) -> Column:
    """Mixed-radix id of the angular slice; 0 for a single dimension.

    The id is a bigint, or a decimal where a bigint cannot hold ``slices ** (d-1)`` ids.
    """
    return _mixed_radix(angular_digits(xs, slices), slices)


def grid_coordinate(x: Column, slices: int) -> Column:
    """Slice of ``x`` in [0, 1); values from 1 on belong to the last slice."""
    return F.when(x >= 1, F.lit(slices - 1).cast("bigint")).otherwise(F.floor(x * slices))


def grid_coordinates(xs: Sequence[Column], slices: int) -> list[Column]:
    return [grid_coordinate(x, slices) for x in xs]


def cell_id(coordinates: Sequence[Column], slices: int) -> Column:
    """Mixed-radix id of the cell: a bigint, or a decimal where a bigint cannot hold all ids."""
    return _mixed_radix(coordinates, slices)


def cell_digits(cell: Column, dims: int, slices: int) -> list[Column]:
    """Coordinates of a cell id, in whole numbers throughout."""
    if slices**dims <= 2**63:
        power = lambda j: F.lit(slices**j).cast("bigint")
    else:
        power = lambda j: F.lit(str(slices**j)).cast(WIDE_ID)
    digits = []
    for j in range(dims):
        below = F.pmod(cell, power(j + 1)) if j + 1 < dims else cell
        digits.append(F.call_function("div", below, power(j)).cast("bigint"))
    return digits


def cell_upper_corner(cell: Column, dims: int, slices: int) -> list[Column]:
    return [(c + 1) / F.lit(float(slices)) for c in cell_digits(cell, dims, slices)]


def dominated_volume(xs: Sequence[Column]) -> Column:
    """Share of the unit cube that the point dominates."""
    return reduce(mul, [1 - x for x in xs])


def finite(x: Column) -> Column:
    """``x`` where it is finite, else null (NaN sorts above infinity)."""
    return F.when((x > F.lit(float("-inf"))) & (x < F.lit(float("inf"))), x)


def rescale(x: Column, lo: Column, hi: Column, half_open: bool = False) -> Column:
    """Min-max scaling; a constant column becomes 0."""
    factor = F.lit(HALF_OPEN_FACTOR) if half_open else F.lit(1.0)
    scaled = factor * (x - lo) / F.nullif(hi - lo, F.lit(0.0))
    return F.when(hi > lo, scaled).when(x.isNotNull(), F.lit(0.0))


def has_number(dtype: T.DataType) -> bool:
    """Whether ``as_number`` knows the type."""
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return isinstance(dtype, (T.NumericType, *times))


def as_number(x: Column, dtype: T.DataType) -> Column:
    """Order-preserving double for a dimension of any numeric or time type."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(x).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # by fields, since a cast to TIMESTAMP is not monotone across clock changes
        seconds = F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)
        return (F.unix_date(x.cast("date")).cast("bigint") * 86400 + seconds).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(x).cast("double")
    return x.cast("double")


def _mixed_radix(digits: Sequence[Column], base: int) -> Column:
    ids = base ** len(digits)
    if ids <= 2**63:
        terms = [d.cast("bigint") * F.lit(base**i).cast("bigint") for i, d in enumerate(digits)]
        return reduce(add, terms, F.lit(0).cast("bigint"))
    if ids > 10**38:
        raise ValueError(
            f"{len(digits)} coordinates with slices={base} make more ids than a decimal holds;"
            " use fewer slices, or the coordinates themselves as key"
        )
    # the largest partial sum is below 10^38, so the cast after each step loses nothing
    total = F.lit(0).cast(WIDE_ID)
    for d in reversed(digits):
        total = (total * F.lit(base) + d).cast(WIDE_ID)
    return total
