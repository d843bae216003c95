"""Frequent tuples: found by a mergeable sketch, and spread by salts in proportion to their rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tuples the sketch follows; its counts are off by at most about rows / TRACKED.
TRACKED = 10_000
SALT = "__sky_salt"
#: A tuple is frequent if it holds more than this part of an even share of the rows.
PART = 0.25


def frequent(df: DataFrame, exprs: Sequence[Column], partitions: int) -> DataFrame:
    """``hash`` and ``salts`` of the tuples that hold more than PART of an even share of the rows.

    At most ``partitions / PART`` tuples can, and all of them are found as long as that is well below TRACKED. The
    rows are read once for their number and the sketch.
    """
    most = min(ceil(partitions / PART), TRACKED // 2)
    hashed = df.select(F.xxhash64(*exprs).alias("hash"))
    sketch = F.expr(f"approx_top_k(hash, {most}, {TRACKED})")
    found = hashed.agg(F.count(F.lit(1)).alias("n"), sketch.alias("top"))
    even = F.greatest(F.col("n") / (partitions / PART), F.lit(1.0))
    return (
        found.select("n", F.inline("top"))
        .select(F.col("item").alias("hash"), F.ceil(F.col("count") / even).cast("int").alias("salts"))
        .filter("salts > 1")
    )


def salted(df: DataFrame, exprs: Sequence[Column], hot: DataFrame) -> DataFrame:
    """``df`` with SALT: of a frequent tuple a number below its salts, else 0.

    ``hot`` is small and stored. The salt comes from the scan partition and the place in it, so a partition
    that is full of one tuple is split as well; which salt a row gets never matters.
    """
    place = F.spark_partition_id() + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = df.withColumns({"__sky_hash": F.xxhash64(*exprs), "__sky_place": place})
    joined = numbered.join(F.broadcast(hot), F.col("__sky_hash") == F.col("hash"), "left")
    salt = F.pmod(F.col("__sky_place"), F.coalesce(F.col("salts"), F.lit(1))).cast("int")
    return joined.withColumn(SALT, salt).drop("hash", "salts", "__sky_hash", "__sky_place")


def repeated(tuples: DataFrame, names: Sequence[str], hot: DataFrame) -> DataFrame:
    """Every tuple once for each of its salts."""
    joined = tuples.join(F.broadcast(hot), F.xxhash64(*names) == F.col("hash"), "left")
    last = F.coalesce(F.col("salts"), F.lit(1)) - 1
    return joined.withColumn(SALT, F.explode(F.sequence(F.lit(0), last))).drop("hash", "salts")
