"""One summary per grid cell in place of all cells below it.

The minima of the occupied cells run along each axis of the coordinate lattice in turn; after the last axis a
cell knows, per dimension, the least value in all cells that are nowhere above it. Taking the summaries of its direct
lower neighbours leaves out the cell itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pareto_frame.functions.dominance import every
from pareto_frame.operators.boxes import OPEN

#: The whole lattice, empty cells included, is laid out up to this number of cells.
LATTICE_CELLS = 1 << 20


def fits(slices: int, n_dims: int) -> bool:
    return slices**n_dims <= LATTICE_CELLS


def minima_below(
    rows: DataFrame, coordinates: Sequence[str], dims: Sequence[str], slices: int
) -> DataFrame:
    """``coordinates`` of the occupied cells and, as the names of ``dims``, the least values below each.

    Coordinates are integers from 0 to ``slices - 1``. Cells below are nowhere greater and differ; without any, the values
    are null. No row can dominate one of cell c from another cell if it is below c's summary in some dimension.
    """
    own = rows.groupBy(*coordinates).agg(
        *[F.min(c).alias(c) for c in dims], F.lit(True).alias("__sky_occupied")
    )
    digit = [F.pmod(F.floor(F.col("id") / slices**i), F.lit(slices)).alias(c) for i, c in enumerate(coordinates)]
    lattice = rows.sparkSession.range(slices ** len(coordinates)).select(*digit)
    cells = lattice.join(own, list(coordinates), "left")
    axes = [
        Window.partitionBy(*[c for c in coordinates if c != axis]).orderBy(axis) for axis in coordinates
    ]
    for axis in axes:
        upto = axis.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumns({c: F.min(c).over(upto) for c in dims})
    lower = {c: [] for c in dims}
    for i, axis in enumerate(axes):
        names = {c: f"__sky_{i}_{j}" for j, c in enumerate(dims)}
        cells = cells.withColumns({name: F.lag(c).over(axis) for c, name in names.items()})
        for c, name in names.items():
            lower[c].append(F.col(name))
    least = [(F.least(*seen) if len(seen) > 1 else seen[0]).alias(c) for c, seen in lower.items()]
    return cells.filter("__sky_occupied").select(*coordinates, *least)


def mark_open(rows: DataFrame, coordinates: Sequence[str], dims: Sequence[str], below: DataFrame) -> DataFrame:
    """Rows with OPEN: whether the summary of the cells below leaves it possible that one dominates the row.

    ``below`` has one row per occupied cell and is broadcast by whoever knows its size.
    """
    names = [f"__sky_m{i}" for i in range(len(dims))]
    cell = F.array(*[F.col(c) for c in coordinates]).alias("__sky_cell")
    summary = below.select(cell, *[F.col(c).alias(n) for c, n in zip(dims, names, strict=True)])
    reached = every([F.col(n) <= F.col(c) for c, n in zip(dims, names, strict=True)])
    return (
        rows.withColumn("__sky_at", F.array(*[F.col(c) for c in coordinates]))
        .join(summary, F.col("__sky_at") == F.col("__sky_cell"), "left")
        .withColumn(OPEN, F.coalesce(reached, F.lit(False)))
        .drop("__sky_at", "__sky_cell", *names)
    )
