"""The skyline query and its strategies.

A strategy finds the distinct dimension tuples of the skyline from a narrow
input (dimensions only, complete rows). The rows that carry these tuples, with
every payload column and every copy, come back by one semi-join, so neither
payload nor copies travel through the shuffles and the local passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, partial, reduce
from math import prod
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pareto_frame.functions.dominance import every, some
from pareto_frame.functions.geometry import (
    angular_digits,
    as_number,
    finite,
    grid_coordinates,
    has_number,
    rescale,
    squared_norm,
)
from pareto_frame.operators import lattice, partitioning
from pareto_frame.operators.aggregates import (
    best_representatives,
    occupied_cells,
    skyline_aggregate,
)
from pareto_frame.operators.cleaning import numeric_dims, quoted
from pareto_frame.operators.joins import (
    BROADCAST_ROWS,
    columns,
    matching_rows,
    minimal_partners,
    surviving_cells,
    survivors,
    survivors_of_many,
)
from pareto_frame.operators.local import OVER, local_skyline, supports, window_pass
from pareto_frame.operators.boxes import box_merge
from pareto_frame.operators.merge import WORTHWHILE, broadcast_merge, global_skyline
from pareto_frame.session import Phase, default_partitions, materialise, no_derived_constraints

FEW_ROWS = 10_000
# Rows of the filters that the strategy without Python takes from the input, and from what those leave.
FRONTIER_ROWS, LARGER_FRONTIER = 1_000, 10_000
# Cells up to this number are shipped to every task in a semi-join; more are shuffled.
BROADCAST_CELLS = 32_768


@dataclass(frozen=True)
class Tuples:
    """Distinct skyline tuples and an upper bound of their number."""

    rows: DataFrame
    at_most: int


@dataclass(frozen=True)
class Input:
    """Complete rows reduced to their dimensions ``xs``."""

    rows: DataFrame
    xs: list[str]
    types: list[T.DataType]
    partitions: int
    limit: int
    extent: tuple | None = None

    def numbers(self) -> list[Column]:
        pairs = zip(self.xs, self.types, strict=True)
        return [as_number(F.col(x), t) for x, t in pairs]

    def summary_columns(self, extent: bool = True) -> list[Column]:
        """Row count, and the finite extent of each dimension."""
        xs = [finite(n) for n in self.numbers()] if extent else []
        ends = [f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(xs) for f in (F.min, F.max)]
        return [F.count(F.lit(1)).alias("n"), *ends]

    @cached_property
    def _summary(self):
        return self.rows.agg(*self.summary_columns()).first()

    @property
    def count(self) -> int:
        return self._summary["n"]

    @property
    def bounds(self) -> list[tuple[float, float]]:
        known = self.extent or self._summary[1:]
        return [
            (known[2 * i] or 0.0, known[2 * i + 1] or 0.0) for i in range(len(self.xs))
        ]

    def unit(self, half_open: bool = False) -> list[Column]:
        """Dimensions scaled to [0, 1]; infinities go to the ends, NaN to 1."""
        scaled = [
            rescale(n, F.lit(lo), F.lit(hi), half_open)
            for n, (lo, hi) in zip(self.numbers(), self.bounds, strict=True)
        ]
        return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) for s in scaled]

    def score(self) -> Column:
        """Monotone: a dominator never has the larger score."""
        return reduce(add, self.unit())

    def having(self, rows: DataFrame) -> Input:
        """The same dimensions over other rows, scaled as before if scaled at all."""
        scaled = "_summary" in self.__dict__
        return replace(self, rows=rows, extent=self._summary[1:] if scaled else self.extent)


def skyline(
    df: DataFrame,
    dims: Sequence[str | Column] | None = None,
    strategy: str = "auto",
    *,
    ties: str = "all",
    nulls: str = "drop",
    tie_break: Sequence[str | Column] | None = None,
    partitions: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    **options,
) -> DataFrame:
    """Rows of ``df`` that no other row dominates; every dimension is minimised.

    dims: column names or expressions (``-F.col("quality")`` maximises); by
        default all numeric columns.
    ties: ``"all"`` keeps every copy of a skyline tuple, with its payload.
        ``"distinct"`` gives the distinct tuples, or with ``tie_break`` the row
        per tuple that comes first in that order (then in column order).
    nulls: rows with a null dimension are dropped, or with ``"keep"`` returned
        as they are, since they neither dominate nor are dominated.
    partitions: partitions of the shuffled local passes.
    broadcast_rows: up to this many candidates, the final merge ships all of
        them to every task; beyond it, blocks of candidates are joined.
    options: settings of the strategy, see ``STRATEGIES``.

    The phases before the final merge run when this is called, because their
    size decides how to go on; the returned DataFrame is lazy.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if ties not in ("all", "distinct") or nulls not in ("drop", "keep"):
        raise ValueError("ties is 'all' or 'distinct', nulls is 'drop' or 'keep'")
    names, exprs = resolve_dims(df, dims)
    xs = [f"__sky_x{i}" for i in range(len(exprs))]
    narrow = df.select(*[e.alias(x) for e, x in zip(exprs, xs, strict=True)])
    source = Input(
        narrow.filter(every([F.col(x).isNotNull() for x in xs])),
        xs,
        [f.dataType for f in narrow.schema.fields],
        partitions or default_partitions(df),
        broadcast_rows,
    )
    found = find_tuples(source, strategy, **options)

    if ties == "distinct" and not tie_break:
        tuples = found.rows
        if nulls == "keep":
            incomplete = narrow.filter(some([F.col(x).isNull() for x in xs])).distinct()
            tuples = tuples.unionByName(incomplete)
        return tuples.select(*[F.col(x).alias(n) for x, n in zip(xs, names, strict=True)])
    rows = matching_rows(df, exprs, found.rows, xs, found.at_most)
    if ties == "distinct":
        rows = first_of_each(rows, exprs, tie_break)
    if nulls == "keep":
        rows = rows.unionByName(df.filter(some([e.isNull() for e in exprs])))
    return rows


def find_tuples(source: Input, strategy: str, given: DataFrame | None = None, **options) -> Tuples:
    """The distinct skyline tuples of complete rows.

    ``given`` points (only for ``representatives``) drop what they dominate before any plan is
    chosen, so the rows do not depend on the number or the types of the dimensions.
    """
    plan = STRATEGIES[strategy]
    if given is not None:
        if plan is not _representatives:
            raise ValueError("given belongs to the strategy 'representatives'")
        if options:
            raise ValueError(f"{', '.join(options)} have no meaning with given points")
        source, plan = _without_dominated(source, given), _sfs_range
    if len(source.xs) == 1:
        return _minimum(source)
    if not all(supports(t) and has_number(t) for t in source.types):
        return _sql(source)
    with no_derived_constraints(source.rows.sparkSession):
        return plan(source, **options)


def _without_dominated(source: Input, given: DataFrame) -> Input:
    named = [quoted(c).alias(x) for c, x in zip(given.columns, source.xs, strict=True)]
    complete = every([F.col(x).isNotNull() for x in source.xs])
    points = replace(source, rows=given.select(*named).filter(complete), extent=None)
    types = [f.dataType for f in points.rows.schema.fields]
    strongest = find_tuples(replace(points, types=types), "auto")
    rivals = materialise(strongest.rows)
    return source.having(survivors_of_many(source.rows, source.xs, rivals, source.limit))


def resolve_dims(
    df: DataFrame, dims: Sequence[str | Column] | None
) -> tuple[list[str], list[Column]]:
    chosen = list(dims) if dims is not None else numeric_dims(df)
    if not chosen:
        raise ValueError("a skyline needs at least one dimension")
    exprs = [quoted(c) if isinstance(c, str) else c for c in chosen]
    return df.select(*exprs).columns, exprs


def first_of_each(rows: DataFrame, exprs: Sequence[Column], tie_break) -> DataFrame:
    order = [quoted(c) if isinstance(c, str) else c for c in tie_break]
    order += [quoted(c) for c in rows.columns]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    whole = F.struct(*[quoted(c) for c in rows.columns])
    return rows.groupBy(*exprs).agg(F.min_by(whole, rank).alias("__sky_row")).select("__sky_row.*")


# Steps shared by the strategies


def _combined(source: Input) -> DataFrame:
    """Partial skylines of the partitions as they are, without a shuffle."""
    return local_skyline(source.rows, source.xs)


def _merged(source: Input, candidates: Phase, native: bool = False) -> Tuples:
    merged = global_skyline(candidates, source.xs, limit=source.limit, native=native)
    return Tuples(merged, candidates.count)


def _distinct(source: Input, rows: DataFrame) -> DataFrame:
    """One shuffle that both removes copies and balances the tasks."""
    return partitioning.spread(rows, source.xs, source.partitions).dropDuplicates(source.xs)


def _from_ranges(source: Input, first: Phase) -> Tuples:
    ranges = partitioning.by_first_dimension(first.rows, source.xs, source.partitions)
    local = local_skyline(ranges, source.xs, presorted=True)
    return _merged(source, materialise(local, phase="local skylines"))


def _keyed_candidates(
    source: Input, unit: list[Column], key: Callable[[list[Column]], Column]
) -> Phase:
    """One local skyline per range of a key over the scaled dimensions.

    They are columns of their own below the key, which then stays small in its plan.
    """
    names = [f"__sky_u{i}" for i in range(len(unit))]
    scaled = [u.alias(n) for u, n in zip(unit, names, strict=True)]
    placed = source.rows.select(*source.xs, *scaled)
    laid = partitioning.by_key(placed, key(columns(names)), source.xs, source.partitions)
    return materialise(local_skyline(laid, source.xs), phase="local skylines")


def _minimum(source: Input) -> Tuples:
    x = source.xs[0]
    low = source.rows.agg(F.min(x).alias(x)).filter(F.col(x).isNotNull())
    return Tuples(low, 1)


# Strategies


def _auto(source: Input) -> Tuples:
    """Local pass where the data lies; a second one on ranges if many tuples are left."""
    first = materialise(_distinct(source, _combined(source)), phase="first pass")
    return _merged(source, first) if first.count <= FEW_ROWS else _from_ranges(source, first)


def _sql(source: Input) -> Tuples:
    """NOT EXISTS as an anti-join, without Python.

    Rows are first filtered by a frontier, those of smallest score, which is sent to every task; what is left is
    stored, and filtered by larger frontiers of its own while that pays. Where the values of all dimensions
    but one make few combinations, only the least of the last one is kept for each. Sizes and ends of
    the scale come from one pass.
    """
    distinct = [F.approx_count_distinct(x).alias(f"values{i}") for i, x in enumerate(source.xs)]
    scaled = all(has_number(t) for t in source.types)
    sizes = source.rows.agg(*source.summary_columns(scaled), *distinct).first()
    ends = tuple(sizes[f"{end}{i}"] for i in range(len(source.xs)) for end in ("min", "max")) if scaled else None
    known = replace(source, extent=ends)
    filtered = scaled and sizes["n"] > FEW_ROWS
    rows = _below_no_frontier(known, FRONTIER_ROWS) if filtered else source.rows
    values = [sizes[f"values{i}"] for i in range(len(source.xs))]
    # the dimension with most values goes last: that leaves the fewest rows
    by_values = sorted(range(len(source.xs)), key=lambda i: values[i])
    if prod(values[i] for i in by_values[:-1]) < sizes["n"] / 2:
        rows = minimal_partners(rows, [source.xs[i] for i in by_values]).select(*source.xs)
    else:
        rows = rows.distinct()
    left = materialise(rows, phase="filtered")
    while filtered and left.count > LARGER_FRONTIER:
        size = left.count
        score = known.score()
        # up to about the wanted number of rows, so that not every task sends as many
        share = min(1.0, 2 * LARGER_FRONTIER / size)
        enough = left.rows.agg(F.percentile_approx(score, share, 10_000)).first()[0]
        near = replace(known, rows=left.rows.filter(score <= F.lit(enough)))
        rows = _below_no_frontier(replace(known, rows=left.rows), LARGER_FRONTIER, near)
        left = materialise(rows, phase="filtered")
        if left.count > WORTHWHILE * size:
            break
    return _merged(source, left, native=True)


def _below_no_frontier(source: Input, size: int, near: Input | None = None) -> DataFrame:
    """Rows that none of the ``size`` rows of smallest score dominates; ``near`` holds those, maybe with others."""
    scored = (near or source).rows.withColumn("__sky_score", source.score())
    first = scored.orderBy("__sky_score", *source.xs).limit(size).select(*source.xs)
    frontier = materialise(first, phase="frontier").rows
    strongest = materialise(survivors(frontier, source.xs, frontier)).rows
    return survivors(source.rows, source.xs, strongest)


def _bnl(source: Input, window: int = 200_000) -> Tuples:
    """Unsorted passes with a window of at most ``window`` tuples on balanced partitions.

    What a full window turns away is stored and goes through another pass, until none is
    turned away; every pass settles at least the tuples that came before the first of those.
    """
    if window < 1:
        raise ValueError("a window holds at least one tuple")
    laid = partitioning.spread(_combined(source), source.xs, source.partitions)
    settled, n = [], 0
    while True:
        phase = materialise(window_pass(laid, source.xs, window), marked=OVER, phase="window")
        settled.append(phase.rows.filter(~F.col(OVER)).drop(OVER))
        n += phase.count - phase.marked
        if not phase.marked:
            break
        # partitions stay as they are, so what was settled has met these rows
        laid = phase.rows.filter(OVER).drop(OVER)
    return _merged(source, Phase(reduce(DataFrame.unionByName, settled), n))


def _sfs(source: Input) -> Tuples:
    """Pass sorted by a monotone score, on what a first pass leaves of the partitions."""
    first = source.having(materialise(_distinct(source, _combined(source)), phase="first pass").rows)
    ordered = first.rows.sortWithinPartitions(first.score(), *source.xs)
    local = local_skyline(ordered, source.xs, presorted=True)
    return _merged(source, materialise(local, phase="local skylines"))


def _sfs_range(source: Input) -> Tuples:
    """Sorted pass on ranges of the first dimension."""
    return _from_ranges(source, materialise(_distinct(source, _combined(source)), phase="first pass"))


def _sfs_random(source: Input) -> Tuples:
    """Sorted pass on balanced partitions."""
    laid = partitioning.spread(_combined(source), source.xs, source.partitions)
    ordered = laid.sortWithinPartitions(*source.xs)
    local = local_skyline(ordered, source.xs, presorted=True)
    return _merged(source, materialise(local, phase="local skylines"))


def _angular(source: Input, slices: int = 32) -> Tuples:
    """Partitions by angle; tuples that compete lie in the same direction."""
    first = source.having(materialise(_distinct(source, _combined(source)), phase="first pass").rows)
    key = partial(_angle_key, slices=slices)
    return _merged(source, _keyed_candidates(first, first.unit(half_open=True), key))


def _angle_key(unit: list[Column], slices: int) -> Column:
    """All angles, as an array: an orderable key for any number of dimensions."""
    return F.array(*angular_digits(unit, slices))


def _radius_angular(source: Input, radius: float = 0.5, slices: int = 32) -> Tuples:
    """Skyline of the ball around the origin first, as a filter for the rest.

    Scaled coordinates are not negative, so a dominator is never farther out:
    the skyline of the ball is final.
    """
    first = source.having(materialise(_distinct(source, _combined(source)), phase="first pass").rows)
    unit = first.unit()
    distance = squared_norm(unit)
    inside = first.rows.filter(distance <= F.lit(radius * radius))
    outside = first.rows.filter(distance > F.lit(radius * radius))

    ranges = partitioning.by_first_dimension(inside, source.xs, source.partitions)
    core = materialise(local_skyline(ranges, source.xs, presorted=True), phase="inner local skylines")
    seed = materialise(global_skyline(core, source.xs, limit=source.limit), phase="inner skyline")
    outside = survivors_of_many(outside, source.xs, seed, source.limit)
    outside = _combined(replace(source, rows=outside))
    outer = _keyed_candidates(first.having(outside), unit, partial(_angle_key, slices=slices))
    both = Phase(seed.rows.unionByName(outer.rows), seed.count + outer.count)
    return _merged(source, both)


def _grid_filter(
    source: Input, slices: int = 32, keep_going: float = 0.8, rounds: int = 4
) -> Tuples:
    """Drop rows in dominated cells, again on a finer scale while that pays."""
    first = materialise(_distinct(source, _combined(source)), phase="first pass")
    for _ in range(rounds):
        size = first.count
        current = replace(source, rows=first.rows, extent=None)
        kept = _combined(replace(source, rows=_in_surviving_cells(current, slices)))
        first = materialise(kept, phase="in surviving cells")
        if first.count > keep_going * size:
            break
    return _from_ranges(source, first)


def _in_surviving_cells(source: Input, slices: int) -> DataFrame:
    names = [f"__sky_c{i}" for i in range(len(source.xs))]
    coordinates = grid_coordinates(source.unit(half_open=True), slices)
    placed = [c.alias(n) for c, n in zip(coordinates, names, strict=True)]
    occupied = occupied_cells(source.rows.select(*placed), names)
    alive = materialise(surviving_cells(occupied, names, source.limit), phase="surviving cells")
    # one key: Spark would derive combinations of many equalities between expressions
    cells = alive.rows.select(F.array(*columns(names)).alias("__sky_cell"))
    cells = F.broadcast(cells) if alive.count <= BROADCAST_CELLS else cells
    return source.rows.join(cells, F.array(*coordinates) == F.col("__sky_cell"), "left_semi")


def _representative_filter(source: Input, per_dim: int) -> DataFrame:
    points = best_representatives(source.rows, source.xs, source.unit(), per_dim)
    # at most dims * per_dim points
    strongest = materialise(points.select(*source.xs).distinct(), phase="representatives").rows
    return survivors(source.rows, source.xs, survivors(strongest, source.xs, strongest))


def _representatives(source: Input, per_dim: int = 10) -> Tuples:
    """What a first pass leaves, filtered by a few points with large dominated volume; sorted ranges.

    The option ``given`` supplies the points instead, in the order of the dimensions; see
    ``find_tuples``.
    """
    first = source.having(materialise(_distinct(source, _combined(source)), phase="first pass").rows)
    return _from_ranges(source, materialise(_representative_filter(first, per_dim), phase="filtered"))


def _three_phase(source: Input, per_dim: int = 10) -> Tuples:
    """Filtered by representatives, sorted slices, with a parallel merge."""
    first = source.having(materialise(_distinct(source, _combined(source)), phase="first pass").rows)
    kept = _representative_filter(first, per_dim)
    ranges = partitioning.by_first_dimension(kept, source.xs, source.partitions)
    local = local_skyline(ranges, source.xs, presorted=True)
    return _merged(source, materialise(local, phase="local skylines"))


def _grid(source: Input, slices: int = 2) -> Tuples:
    """Partitions by grid cell; the key is the array of all coordinates."""
    first = source.having(materialise(_distinct(source, _combined(source)), phase="first pass").rows)
    def key(unit: list[Column]) -> Column:
        return F.array(*grid_coordinates(unit, slices))

    return _merged(source, _keyed_candidates(first, first.unit(half_open=True), key))


def _grid_parallel(source: Input, slices: int = 2) -> Tuples:
    """Dominated cells dropped, one skyline per cell, cells refined by what lies below them.

    Of more candidates than are broadcast, those that the summary of the cells below rules out are
    final; the others meet candidates by super-boxes.
    """
    first = source.having(materialise(_distinct(source, _combined(source)), phase="first pass").rows)
    alive = _combined(replace(source, rows=_in_surviving_cells(first, slices)))
    names = [f"__sky_c{i}" for i in range(len(source.xs))]
    coordinates = grid_coordinates(first.unit(half_open=True), slices)
    placed = alive.select(
        *source.xs, *[c.alias(n) for c, n in zip(coordinates, names, strict=True)]
    )
    cell = F.array(*columns(names))
    laid = partitioning.by_key(placed, cell, source.xs, source.partitions)
    # the coordinates are keys of the local pass: cells do not compete there
    laid = laid.sortWithinPartitions(*names)
    local = local_skyline(laid, source.xs, keys=names, by_key=True)
    candidates = materialise(local, phase="local skylines")
    if candidates.count <= source.limit:
        merged = global_skyline(candidates, source.xs, limit=source.limit)
        return Tuples(merged.select(*source.xs), candidates.count)
    mark = None
    if lattice.fits(slices, len(source.xs)):
        below = materialise(lattice.minima_below(candidates.rows, names, source.xs, slices))
        summary = F.broadcast(below.rows) if below.count <= BROADCAST_CELLS else below.rows

        def mark(rows: DataFrame) -> DataFrame:
            placed = rows.withColumns(dict(zip(names, coordinates, strict=True)))
            return lattice.mark_open(placed, names, source.xs, summary)

    tuples = Phase(candidates.rows.select(*source.xs), candidates.count)

    def few(left: Phase) -> DataFrame | None:
        return broadcast_merge(left.rows, source.xs) if left.count <= source.limit else None

    return Tuples(box_merge(tuples, source.xs, mark=mark, after_local=few), candidates.count)


def _aggregate(source: Input) -> Tuples:
    """Partial skylines folded as lists, level by level."""
    merged = materialise(skyline_aggregate(_combined(source), source.xs, limit=source.limit))
    return Tuples(merged.rows, merged.count)


STRATEGIES: dict[str, Callable[..., Tuples]] = {
    "auto": _auto,
    "sql": _sql,
    "nested_loop": _sql,
    "bnl": _bnl,
    "sfs": _sfs,
    "sfs_range": _sfs_range,
    "sfs_random": _sfs_random,
    "angular": _angular,
    "radius_angular": _radius_angular,
    "grid_filter": _grid_filter,
    "representatives": _representatives,
    "three_phase": _three_phase,
    "grid": _grid,
    "grid_parallel": _grid_parallel,
    "aggregate": _aggregate,
}
