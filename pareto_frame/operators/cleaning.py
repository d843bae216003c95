"""Projection, cleaning and scaling of measure columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pareto_frame.functions.geometry import as_number, finite, rescale, squared_norm


def keep_measures(
    df: DataFrame, wanted: int, drop_order: Sequence[int], always_drop: int, least: int, most: int
) -> DataFrame:
    """Keep ``wanted`` positional columns (clamped to ``least``..``most``).

    Columns leave in ``drop_order``: the first ``always_drop`` of it, then one
    more for every measure fewer than ``most``.
    """
    wanted = min(max(wanted, least), most)
    dropped = {df.columns[i] for i in drop_order[: always_drop + most - wanted]}
    return df.select(*[quoted(c) for c in df.columns if c not in dropped])


def drop_duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.distinct()


# What is read as a number: decimal notation with an optional exponent, or a named value.
NUMBER = r"(?i)^\s*[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Read text as double; text that is no number becomes null.

    Type suffixes (``1d``, ``2.5F``) and hexadecimal notation are no numbers.
    """
    chosen = set(columns or df.columns)
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

    def number(c: str) -> Column:
        value = quoted(c).try_cast("double")
        return F.when(quoted(c).rlike(NUMBER), value) if c in texts else value

    return df.select(*[number(c).alias(c) if c in chosen else quoted(c) for c in df.columns])


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns or df.columns))


def numeric_dims(df: DataFrame) -> list[str]:
    """Default dimensions: the numeric columns, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def extent(df: DataFrame, dims: Sequence[str], per_dim: bool = False) -> DataFrame:
    """One row: ``lo``/``hi`` over all dimensions, or ``lo_i``/``hi_i`` for each.

    Infinite values and NaN do not take part.
    """
    xs = [finite(x) for x in _numbers(df, dims)]
    los, his = [F.min(x) for x in xs], [F.max(x) for x in xs]
    if per_dim:
        named = [lo.alias(f"lo_{i}") for i, lo in enumerate(los)]
        return df.agg(*named, *[hi.alias(f"hi_{i}") for i, hi in enumerate(his)])
    lo = F.least(*los) if len(los) > 1 else los[0]
    hi = F.greatest(*his) if len(his) > 1 else his[0]
    return df.agg(lo.alias("lo"), hi.alias("hi"))


def _numbers(df: DataFrame, dims: Sequence[str]) -> list[Column]:
    """The columns as doubles, also dates and times."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [as_number(quoted(c), types[c]) for c in dims]


def normalise(
    df: DataFrame, dims: Sequence[str], half_open: bool = False, per_dim: bool = False
) -> DataFrame:
    """Min-max scale ``dims`` with one shared extent, or one per dimension.

    The extent (two numbers, or two per dimension) is read by a job when this is
    called; the scaling itself is a projection.
    """
    bounds = extent(df, dims, per_dim).first()
    scaled = {}
    for i, (c, x) in enumerate(zip(dims, _numbers(df, dims), strict=True)):
        lo, hi = (f"lo_{i}", f"hi_{i}") if per_dim else ("lo", "hi")
        scaled[c] = rescale(x, F.lit(bounds[lo] or 0.0), F.lit(bounds[hi] or 0.0), half_open)
    return df.withColumns(scaled)


def annulus(
    df: DataFrame, dims: Sequence[str | Column], inner: float = 0.0, outer: float = 0.2
) -> DataFrame:
    """Rows whose distance to the origin is within both radii, ends included."""
    xs = [quoted(c) if isinstance(c, str) else c for c in dims]
    return df.filter(squared_norm(xs).between(F.lit(inner * inner), F.lit(outer * outer)))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
