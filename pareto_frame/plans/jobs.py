"""Experiments over the strategies. Only counts and timings reach the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pareto_frame.functions.dominance import every
from pareto_frame.functions.geometry import cell_id, grid_coordinates
from pareto_frame.operators.aggregates import best_representatives
from pareto_frame.operators.cleaning import normalise
from pareto_frame.operators.joins import BROADCAST_ROWS, survivors
from pareto_frame.plans.grouped import skyline_by
from pareto_frame.plans.skyline import STRATEGIES, Input, resolve_dims, skyline
from pareto_frame.session import default_partitions, materialise, recorded_phases, scratch_path


def phase_counts(
    df: DataFrame, dims: Sequence[str | Column], per_dim: int = 10, slices: int = 4
) -> DataFrame:
    """Rows left after each phase: input, representative filter, local, global.

    Local skylines are those of grid cells, so that the counts depend on the
    data alone and not on how it is partitioned.
    """
    _, exprs = resolve_dims(df, dims)
    xs = [f"__sky_x{i}" for i in range(len(exprs))]
    narrow = df.select(*[e.alias(x) for e, x in zip(exprs, xs, strict=True)])
    rows = narrow.filter(every([F.col(x).isNotNull() for x in xs]))
    types = [f.dataType for f in narrow.schema.fields]
    units = Input(rows, xs, types, default_partitions(df), BROADCAST_ROWS).unit()

    points = best_representatives(rows, xs, units, per_dim)
    strongest = materialise(points.select(*xs).distinct())
    cell = cell_id(grid_coordinates(units, slices), slices).alias("cell")
    filtered = survivors(rows, xs, strongest.rows).select(cell, *xs)
    counts = [
        rows.agg(F.count(F.lit(1)).alias("n_rows")),
        filtered.agg(F.count(F.lit(1)).alias("n_filtered")),
        skyline_by(filtered, ["cell"], xs).agg(F.count(F.lit(1)).alias("n_local")),
        skyline(filtered, xs, ties="distinct").agg(F.count(F.lit(1)).alias("n_skyline")),
    ]
    found = {c.columns[0]: c.first()[0] for c in counts}
    return df.sparkSession.createDataFrame(
        [tuple(found.values())], ", ".join(f"{n} bigint" for n in found)
    )


def skyline_with_phases(
    df: DataFrame, dims: Sequence[str | Column], strategy: str = "auto", **settings
) -> tuple[DataFrame, DataFrame]:
    """What ``skyline`` returns, stored, and the exact sizes of the phases of that very run.

    Phases: step, phase, n_rows. The first is the input (complete rows, counted as they are read), the last the
    result; those between are what the strategy stored on its way, in order. ``merge candidates`` are the
    rows of the last of them.
    """
    rows, phases = _observed(df, dims, strategy, **settings)
    steps = [(i, name, n) for i, (name, n) in enumerate(phases)]
    return rows, df.sparkSession.createDataFrame(steps, "step int, phase string, n_rows bigint")


def _observed(
    df: DataFrame, dims: Sequence[str | Column], strategy: str, **settings
) -> tuple[DataFrame, list[tuple[str, int]]]:
    _, exprs = resolve_dims(df, dims)
    complete = every([e.isNotNull() for e in exprs])
    read = Observation()
    watched = df.observe(read, F.count_if(complete).alias("n"))
    with recorded_phases() as phases:
        found = materialise(skyline(watched, dims, strategy, **settings), phase="skyline")
    return found.rows, [("input", int(read.get["n"])), *phases]


@dataclass(frozen=True)
class Case:
    """One cell of a grid of experiments; ``scaling``: none, shared or half_open min-max scaling."""

    kind: str
    n: int
    dims: int
    strategy: str
    scaling: str = "none"

    @property
    def name(self) -> str:
        return f"{self.kind}-{self.n}-{self.dims}-{self.strategy}-{self.scaling}"


def grid_of(kinds, sizes, dims, strategies, scalings=("none",)) -> list[Case]:
    return [Case(*cell) for cell in product(kinds, sizes, dims, strategies, scalings)]


RESULT = (
    "kind string, n bigint, dims int, strategy string, scaling string, n_input bigint, candidates bigint,"
    " size bigint, seconds double"
)


def run_grid(
    spark: SparkSession, cases: Sequence[Case], points: Callable[[Case], DataFrame], folder: str | None = None
) -> DataFrame:
    """Every case of a grid, one row each: rows read, candidates of the final merge, skyline tuples, time.

    ``points`` gives the input of a case; its columns x0, x1, ... are the dimensions. Each result is written below
    ``folder`` at once, and a case that is found there is not run again, so a grid that was
    broken off goes on where it ended.
    """
    folder = (folder or scratch_path(spark, "grid")).rstrip("/")
    for case in cases:
        path = f"{folder}/{case.name}"
        if not _exists(spark, path):
            _run_case(spark, case, points).write.mode("overwrite").parquet(path)
    return spark.read.schema(RESULT).parquet(*[f"{folder}/{c.name}" for c in cases])


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete result is there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _run_case(spark: SparkSession, case: Case, points: Callable[[Case], DataFrame]) -> DataFrame:
    xs = [f"x{i}" for i in range(case.dims)]
    # drawing the points is not part of what is timed
    rows = materialise(points(case).select(*xs)).rows
    begin = time.perf_counter()
    if case.scaling != "none":
        rows = normalise(rows, xs, half_open=case.scaling == "half_open")
    _, phases = _observed(rows, xs, case.strategy, ties="distinct")
    taken = time.perf_counter() - begin
    n_rows = [n for _, n in phases]
    line = [case.kind, case.n, case.dims, case.strategy, case.scaling, n_rows[0], n_rows[-2], n_rows[-1], taken]
    fields = [field.split() for field in RESULT.split(",")]
    return spark.range(1).select(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(line, fields, strict=True)])


def sweep_sizes(
    inputs: Mapping[str, DataFrame],
    dims: Sequence[str | Column],
    strategies: Sequence[str] = ("sfs_range",),
    ties: str = "distinct",
) -> DataFrame:
    """Skyline size and time for inputs of growing size."""
    spark = next(iter(inputs.values())).sparkSession
    measured = []
    for name, points in inputs.items():
        n = points.count()
        for strategy in strategies:
            begin = time.perf_counter()
            size = skyline(points, dims, strategy, ties=ties).count()
            measured.append((name, strategy, n, size, time.perf_counter() - begin))
    return spark.createDataFrame(
        measured, "input string, strategy string, n bigint, size bigint, seconds double"
    )


def compare_strategies(
    df: DataFrame,
    dims: Sequence[str | Column],
    strategies: Sequence[str] | None = None,
    ties: str = "all",
) -> DataFrame:
    """Per strategy, how many rows it misses or adds compared with ``sql``."""
    expected = materialise(skyline(df, dims, "sql", ties=ties)).rows
    lines = []
    for strategy in strategies or STRATEGIES:
        found = materialise(skyline(df, dims, strategy, ties=ties)).rows
        missing = expected.exceptAll(found).select(F.lit(1).alias("m"), F.lit(0).alias("s"))
        surplus = found.exceptAll(expected).select(F.lit(0).alias("m"), F.lit(1).alias("s"))
        total = missing.unionByName(surplus).agg(
            F.coalesce(F.sum("m"), F.lit(0)).alias("missing"),
            F.coalesce(F.sum("s"), F.lit(0)).alias("surplus"),
        )
        lines.append(total.select(F.lit(strategy).alias("strategy"), "missing", "surplus"))
    return reduce(DataFrame.unionByName, lines)
