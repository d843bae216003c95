"""Representative points, cells, and the mergeable skyline aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pareto_frame.functions.dominance import strictly_dominates, weakly_dominates
from pareto_frame.functions.geometry import dominated_volume
from pareto_frame.operators.frequent import SALT, frequent, repeated, salted
from pareto_frame.operators.joins import BROADCAST_ROWS, SEMI_BROADCAST_VALUES
from pareto_frame.operators.merge import global_skyline
from pareto_frame.session import Phase, default_partitions, materialise

FOLD_ROWS = 500


def best_representatives(
    df: DataFrame, dims: Sequence[str], scaled: Sequence[Column], per_dim: int = 10
) -> DataFrame:
    """Per dimension and slice, the point that dominates the largest volume.

    ``scaled`` are the dimensions in [0, 1]. At most ``len(dims) * per_dim``
    points; equal volumes go to the lexicographically smallest point. Volumes
    are aggregated first because a plain maximum needs no sort: the points come
    from a second pass that keeps only rows that match a winning volume.
    """
    slots = F.array(
        *[
            F.struct(
                F.lit(i).alias("dim"),
                F.least(F.floor(x * per_dim), F.lit(per_dim - 1)).cast("int").alias("bucket"),
            )
            for i, x in enumerate(scaled)
        ]
    )
    points = (
        df.select(*dims, dominated_volume(scaled).alias("__sky_volume"), slots.alias("__sky_slots"))
        .filter((F.col("__sky_volume") > 0) & (F.col("__sky_volume") <= 1))
        .select(*dims, "__sky_volume", F.inline("__sky_slots"))
    )
    largest = points.groupBy("dim", "bucket").agg(F.max("__sky_volume").alias("__sky_volume"))
    winners = points.join(F.broadcast(largest), ["dim", "bucket", "__sky_volume"])
    return (
        winners.groupBy("dim", "bucket")
        .agg(F.min(F.struct(*dims)).alias("best"))
        .select("dim", "bucket", "best.*")
    )


def occupied_cells(df: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    return df.select(*coordinates).distinct()


def pack_cells(df: DataFrame, cell: str, dims: Sequence[str], chunk_rows: int = 1_000) -> DataFrame:
    """Rows packed as arrays: one or more chunks per cell, of bounded size.

    A cell may hold any share of the rows, so its rows are spread over chunks
    by hash, and copies of a tuple are packed once with their number.
    """
    counted = df.groupBy(cell, *dims).agg(F.count(F.lit(1)).alias("copies"))
    sizes = counted.groupBy(cell).agg(F.count(F.lit(1)).alias("__sky_size"))
    large = materialise(sizes.filter(F.col("__sky_size") > chunk_rows))
    if large.count <= SEMI_BROADCAST_VALUES // 2:
        sized = counted.join(F.broadcast(large.rows), cell, "left")
    else:
        # a cell with many tuples is one key of this join, so it is split
        hot = materialise(frequent(counted, [F.col(cell)], default_partitions(df))).rows
        copies = repeated(large.rows, [cell], hot)
        sized = salted(counted, [F.col(cell)], hot).join(copies, [cell, SALT], "left").drop(SALT)
    chunks = F.ceil(F.coalesce(F.col("__sky_size"), F.lit(1)) / F.lit(chunk_rows))
    return (
        sized.withColumn("chunk", F.pmod(F.xxhash64(*dims), chunks))
        .groupBy(cell, "chunk")
        .agg(F.collect_list(F.struct(*dims, "copies")).alias("points"))
    )


def fold_skyline(points: Column, dims: Sequence[str]) -> Column:
    """Skyline of an array of structs, as one expression."""

    def fields(point: Column) -> list[Column]:
        return [point.getField(c) for c in dims]

    def merge(kept: Column, point: Column) -> Column:
        covered = F.exists(kept, lambda k: weakly_dominates(fields(k), fields(point)))
        others = F.filter(kept, lambda k: ~strictly_dominates(fields(point), fields(k)))
        return F.when(covered, kept).otherwise(F.concat(others, F.array(point)))

    return F.aggregate(points, F.slice(points, 1, 0), merge)


def skyline_aggregate(
    tuples: DataFrame,
    dims: Sequence[str],
    keys: Sequence[str] = (),
    fold_rows: int = FOLD_ROWS,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Distinct tuples merged as partial skylines, level by level.

    Every level folds buckets of about ``fold_rows`` tuples per key, so no list
    grows with its group. When a level no longer shrinks the input much, the
    rest is merged by joins.
    """
    phase = materialise(tuples.select(*keys, *dims).distinct())
    while phase.count:
        largest = _largest_group(phase, keys)
        buckets = ceil(largest / fold_rows)
        folded = (
            phase.rows.groupBy(*keys, F.pmod(F.xxhash64(*dims), F.lit(buckets)).alias("__sky_b"))
            .agg(F.collect_list(F.struct(*dims)).alias("__sky_points"))
            .select(*keys, F.inline(fold_skyline(F.col("__sky_points"), dims)))
        )
        if buckets == 1:
            return folded
        smaller = materialise(folded)
        if smaller.count > 0.7 * phase.count:
            return global_skyline(smaller, dims, keys, limit)
        phase = smaller
    return phase.rows


def _largest_group(phase: Phase, keys: Sequence[str]) -> int:
    if not keys:
        return phase.count
    sizes = phase.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0]
