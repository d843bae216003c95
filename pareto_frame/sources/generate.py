"""Reproducible synthetic points.

Every coordinate is computed from a row id by integer arithmetic, so the points
do not depend on partitioning, can be recomputed after a lost task, and are the
same in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the three mixing rounds; all products stay below 2**62.
PRIME = 2147483647
FIRST_ROUND = (48271, 7919, 1)
SECOND_ROUND = (12345, 104729)
THIRD_ROUND = (777, 15485863)

KINDS = ("independent", "correlated", "anti_correlated")


def with_draws(df: DataFrame, key: Column, dims: int) -> DataFrame:
    """Add pseudo-random doubles in [0, 1) as ``__sky_u0``, ``__sky_u1``, ...

    One projection per mixing round: a round uses its input twice, and nested
    expressions would double with each. Declared as never null (NaN for a row
    without id), so that null checks of later steps cost nothing.
    """
    p = F.lit(PRIME).cast("bigint")
    mixed = [f"__sky_u{j}" for j in range(dims)]
    factor = F.lit(FIRST_ROUND[0]).cast("bigint")
    df = df.withColumns(
        {
            u: F.pmod(key * factor + F.lit(FIRST_ROUND[1] * j + FIRST_ROUND[2]), p)
            for j, u in enumerate(mixed)
        }
    )
    for constant, step in (SECOND_ROUND, THIRD_ROUND):
        df = df.withColumns(
            {
                u: F.pmod(F.col(u) * F.col(u) + F.lit(constant + step * j), p)
                for j, u in enumerate(mixed)
            }
        )
    unit = {
        u: F.coalesce(F.col(u).cast("double") / F.lit(float(PRIME)), F.lit(float("nan")))
        for u in mixed
    }
    return df.withColumns(unit)


def with_points(
    df: DataFrame,
    row_id: str | Column,
    kind: str = "independent",
    *,
    dims: int = 4,
    lo: float = 0.0,
    hi: float = 1.0,
    spread: float = 10.0,
    seed: int = 0,
) -> DataFrame:
    """Add columns ``x0 .. x{dims-1}``, drawn per row id.

    ``spread`` (in percent) is how far the other coordinates scatter around the
    first one (correlated) or around what it leaves of the range
    (anti-correlated); they may leave the range.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    key = (F.col(row_id) if isinstance(row_id, str) else row_id).cast("bigint")
    drawn = with_draws(df, key + F.lit(seed).cast("bigint"), dims)
    draws = [F.col(f"__sky_u{j}") for j in range(dims)]
    drawn = drawn.withColumn("x0", draws[0] * F.lit(hi - lo) + F.lit(lo))
    width = F.lit(spread * 0.01)
    others = {}
    for j, u in enumerate(draws[1:], start=1):
        if kind == "independent":
            others[f"x{j}"] = u * F.lit(hi - lo) + F.lit(lo)
        elif kind == "correlated":
            others[f"x{j}"] = F.col("x0") + (u - F.lit(0.5)) * width
        else:
            left = F.lit(hi) - F.col("x0")
            others[f"x{j}"] = left + left * (u - F.lit(0.5)) * width
    if others:
        drawn = drawn.withColumns(others)
    return drawn.drop(*[f"__sky_u{j}" for j in range(dims)])


def generate_points(
    spark: SparkSession, n: int = 10**6, kind: str = "independent", **settings
) -> DataFrame:
    """``n`` points with ids 0 .. n-1; settings as in ``with_points``."""
    return with_points(spark.range(n), "id", kind, **settings)


# The small cost/distance example, its skyline first known by hand.
TOY_POINTS = [
    (350, 190),
    (400, 250),
    (320, 500),
    (430, 140),
    (550, 130),
    (360, 420),
    (580, 500),
    (410, 600),
    (330, 210),
    (210, 400),
]
TOY_SKYLINE = [(350, 190), (330, 210), (430, 140), (210, 400), (550, 130)]


def toy_points(spark: SparkSession, n: int = 10) -> DataFrame:
    """The toy set; beyond ten rows, padded with dominated ones."""
    base = spark.createDataFrame(TOY_POINTS, "x0 bigint, x1 bigint")
    if n <= len(TOY_POINTS):
        return base
    return base.unionByName(toy_padding(spark.range(n - len(TOY_POINTS)), "id"))


def toy_padding(df: DataFrame, row_id: str) -> DataFrame:
    """One dominated toy point per id 0, 1, ...: a skyline point moved outwards.

    The offset grows with the id in both coordinates, the first, or the second,
    in turn, and is at least one in each.
    """
    i = F.col(row_id).cast("bigint")
    corners = F.array(
        *[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in TOY_SKYLINE]
    )
    corner = F.element_at(corners, (F.pmod(i, F.lit(5)) + 1).cast("int"))
    turn = F.pmod(i, F.lit(3))
    far, near = i + 1, F.lit(1).cast("bigint")
    return df.select(
        (corner.getField("x") + F.when(turn == 2, near).otherwise(far)).alias("x0"),
        (corner.getField("y") + F.when(turn == 0, near).otherwise(far)).alias("x1"),
    )
