"""From local skylines to the global one, without a driver or single-task pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pareto_frame.functions.dominance import every, strictly_dominates, weakly_dominates
from pareto_frame.functions.geometry import as_number, finite, has_number, rescale
from pareto_frame.operators.boxes import box_merge
from pareto_frame.operators.joins import (
    BROADCAST_ROWS,
    as_rivals,
    columns,
    few_enough,
    rival_names,
    survivors,
)
from pareto_frame.operators.local import supports
from pareto_frame.operators.partitioning import piece, tasks_for
from pareto_frame.session import Phase, materialise

WORTHWHILE = 0.8
BLOCK_ROWS = 4_000
# Rows that filter the candidates of a block merge at a time, at most one of each block.
CHAMPIONS = 2_000
# Ranges of the two-dimensional sweep, whose summaries pass one task.
MAX_BLOCKS = 10_000
BLOCK = "__sky_block"


def global_skyline(
    candidates: Phase,
    dims: Sequence[str],
    keys: Sequence[str] = (),
    limit: int = BROADCAST_ROWS,
    native: bool = False,
) -> DataFrame:
    """Candidates that no other candidate (of the same key) dominates.

    ``candidates`` are distinct tuples. Their exact count picks the method, and
    each method is exact for any input. Types without a 64-bit form (text, long decimals)
    are merged by joins of blocks, as with ``native``; all others by super-boxes.
    """
    if not keys and len(dims) == 1:
        return candidates.rows.agg(F.min(dims[0]).alias(dims[0])).filter(
            F.col(dims[0]).isNotNull()
        )
    if few_enough(candidates, [*keys, *dims], limit):
        return broadcast_merge(candidates.rows, dims, keys)
    if not keys and len(dims) == 2:
        return sweep_merge(candidates, dims)
    types = {f.name: f.dataType for f in candidates.rows.schema.fields}
    if not native and all(supports(types[c]) for c in dims):
        return box_merge(
            candidates,
            dims,
            keys,
            after_local=lambda left: broadcast_merge(left.rows, dims, keys) if few_enough(left, [*keys, *dims], limit) else None,
        )
    blocks = cut_into_blocks(candidates, dims, keys)
    while not keys:
        smaller = materialise(below_no_corner(blocks, dims))
        if few_enough(smaller, dims, limit):
            return broadcast_merge(smaller.rows, dims)
        if smaller.count > WORTHWHILE * candidates.count:
            break
        candidates = smaller
        blocks = cut_into_blocks(candidates, dims)
    return block_merge(blocks, dims, keys)


def below_no_corner(blocks: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows that no block dominates as a whole.

    A row worse than the upper corner of a block is dominated by every row of
    that block. There is one corner for BLOCK_ROWS candidates.
    """
    corners = blocks.groupBy(BLOCK).agg(*[F.max(c).alias(c) for c in dims])
    return survivors(blocks, dims, corners).select(*dims)


def broadcast_merge(rows: DataFrame, dims: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every candidate against all of them; only for a checked size."""
    return _outside_of(rows, dims, keys, rows)


def _outside_of(rows: DataFrame, dims: Sequence[str], keys: Sequence[str], rivals: DataFrame) -> DataFrame:
    """Rows that no rival of the same key dominates; ``rivals`` must be small."""
    own = [F.col(k).alias(f"__sky_key{i}") for i, k in enumerate(keys)]
    rivals = as_rivals(rivals, dims, *own)
    condition = strictly_dominates(columns(rival_names(dims)), columns(dims))
    for i, k in enumerate(keys):
        condition = F.col(k).eqNullSafe(F.col(f"__sky_key{i}")) & condition
    return rows.join(F.broadcast(rivals), condition, "left_anti")


def sweep_merge(candidates: Phase, dims: Sequence[str]) -> DataFrame:
    """Two dimensions: sorted ranges of the first, running minima of the second."""
    x, y = dims
    best = candidates.rows.groupBy(x).agg(F.min(y).alias(y))
    blocks = min(max(ceil(candidates.count / BLOCK_ROWS), 1), MAX_BLOCKS)
    laid = materialise(
        best.repartitionByRange(blocks, x).withColumn(BLOCK, F.spark_partition_id())
    ).rows
    earlier_blocks = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # one row per block, so at most MAX_BLOCKS rows in this window and broadcast
    before = (
        laid.groupBy(BLOCK)
        .agg(F.min(y).alias("__sky_low"))
        .select(BLOCK, F.min("__sky_low").over(earlier_blocks).alias("__sky_before"))
    )
    earlier_rows = (
        Window.partitionBy(BLOCK).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    )
    beaten = F.coalesce(F.col(y) >= F.col("__sky_before"), F.lit(False)) | F.coalesce(
        F.col(y) >= F.col("__sky_running"), F.lit(False)
    )
    return (
        laid.join(F.broadcast(before), BLOCK)
        .withColumn("__sky_running", F.min(y).over(earlier_rows))
        .filter(~beaten)
        .select(x, y)
    )


def cut_into_blocks(
    candidates: Phase, dims: Sequence[str], keys: Sequence[str] = (), lead: Sequence[Column] = ()
) -> DataFrame:
    """Add a block number: about equal numbers of neighbouring tuples.

    Tuples are distinct, so a range partition over all dimensions can always be
    cut and no block outgrows the others. Many blocks share tasks, which cut their sorted range. The blocks are
    checkpointed because their numbers must not change between the joins that use them.
    """
    blocks = max(ceil(candidates.count / BLOCK_ROWS), 1)
    lead = list(lead) or _quantile_buckets(candidates.rows, dims, blocks)
    tasks = tasks_for(candidates.rows, candidates.count, blocks)
    # as columns, since a sort computes expressions again for every comparison
    leads = {f"__sky_lead{i}": x for i, x in enumerate(lead)}
    order = [*keys, *leads, *dims]
    laid = candidates.rows.withColumns(leads).repartitionByRange(tasks, *order)
    if tasks == blocks:
        numbered = laid.withColumn(BLOCK, F.spark_partition_id().cast("long"))
    else:
        numbered = laid.sortWithinPartitions(*order).withColumn(BLOCK, piece(BLOCK_ROWS))
    return materialise(numbered.drop(*leads)).rows


def block_merge(
    rows: DataFrame,
    dims: Sequence[str],
    keys: Sequence[str] = (),
    cells: Sequence[str] = (),
) -> DataFrame:
    """Compare each block only with the blocks that can hold dominators.

    Rows that the best row of some block dominates go first, and what is left is cut into blocks again: each row of
    a block is copied for every block it may meet, so copies have to follow the rows that may stay, not the input.

    The corners of each block decide which pairs of blocks meet, and the corner
    of the other block which rows take part. Rows then meet in an equi-join on
    the pair, in which neither side has more rows than one block.

    ``cells`` names grid coordinates, constant within a block, that narrow the
    pairs to cells below or equal in every coordinate.
    """
    place = [*keys, BLOCK, *cells]
    complete = every([F.col(c).isNotNull() for c in dims])
    # rows with a null dimension neither dominate nor are dominated
    apart = rows.filter(~complete).select(*keys, *dims)
    rows = _below_no_champion(rows.filter(complete), dims, keys, cells)
    low = [F.min(c).alias(f"__sky_lo{i}") for i, c in enumerate(dims)]
    high = [F.max(c).alias(f"__sky_hi{i}") for i, c in enumerate(dims)]
    corners = materialise(rows.groupBy(*place).agg(*low, *high))
    boxes = corners.rows

    lows = [f"__sky_lo{i}" for i in range(len(dims))]
    highs = [f"__sky_hi{i}" for i in range(len(dims))]
    upper = boxes.select(
        *[F.col(c).alias(f"__sky_b{i}") for i, c in enumerate(place)], *highs
    )
    lower = boxes.select(*[F.col(c).alias(f"__sky_a{i}") for i, c in enumerate(place)], *lows)
    a = [F.col(f"__sky_a{i}") for i in range(len(place))]
    b = [F.col(f"__sky_b{i}") for i in range(len(place))]
    n_keys = len(keys)
    may = weakly_dominates(columns(lows), columns(highs))
    if cells:
        may = may & weakly_dominates(a[n_keys + 1 :], b[n_keys + 1 :])
    same_key = [x.eqNullSafe(y) for x, y in zip(a[:n_keys], b[:n_keys], strict=True)]
    if few_enough(corners, place, BROADCAST_ROWS):
        upper = F.broadcast(upper)
    pairs = lower.join(upper, every([*same_key, may]))

    here = columns(place)
    p_side = rows.join(
        pairs,
        _same_place(here, b, n_keys)
        & weakly_dominates(columns(lows), columns(dims)),
    ).select(*a, *b, *dims)
    q_side = rows.join(
        pairs,
        _same_place(here, a, n_keys)
        & weakly_dominates(columns(dims), columns(highs)),
    )
    pair_names = [f"__sky_{side}{i}" for side in "ab" for i in range(len(place))]
    q_side = as_rivals(q_side, dims, *[F.col(c).alias(f"{c}_q") for c in pair_names])
    theirs = columns([f"{c}_q" for c in pair_names])
    half = len(place)
    meet = _same_place(a, theirs[:half], n_keys) & _same_place(b, theirs[half:], n_keys)
    beaten = p_side.join(
        q_side, meet & strictly_dominates(columns(rival_names(dims)), columns(dims)), "left_semi"
    )
    own = [F.col(f"__sky_b{i}").alias(f"__sky_key{i}") for i in range(n_keys)]
    beaten = as_rivals(beaten, dims, *own).distinct()
    gone = [F.col(c) == F.col(q) for c, q in zip(dims, rival_names(dims), strict=True)]
    gone += [F.col(k).eqNullSafe(F.col(f"__sky_key{i}")) for i, k in enumerate(keys)]
    return apart.unionByName(rows.join(beaten, every(gone), "left_anti").select(*keys, *dims))


def _below_no_champion(
    blocks: DataFrame, dims: Sequence[str], keys: Sequence[str], cells: Sequence[str]
) -> DataFrame:
    """Complete rows, in blocks, that no *champion* dominates: the row of smallest score of a block.

    Repeated with blocks of what is left as long as that drops many. At most CHAMPIONS rows filter at a time.
    """
    types = {f.name: f.dataType for f in blocks.schema.fields}
    measured = {c: finite(as_number(F.col(c), types[c])) for c in dims if has_number(types[c])}
    ends = [f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(measured.values()) for f in (F.min, F.max)]
    known = blocks.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    score = F.lit(0.0)
    for i, c in enumerate(measured):
        lo, hi = known[f"min{i}"] or 0.0, known[f"max{i}"] or 0.0
        unit = rescale(as_number(F.col(c), types[c]), F.lit(lo), F.lit(hi))
        score += F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit))
    left = Phase(blocks, known["n"])
    while left.count > BLOCK_ROWS:
        best = F.min(F.struct(score.alias("__sky_score"), *dims)).alias("__sky_best")
        champions = left.rows.groupBy(*keys, BLOCK).agg(best).select(*keys, "__sky_best.*")
        first = champions.orderBy("__sky_score", *dims).limit(CHAMPIONS).select(*keys, *dims)
        strongest = materialise(broadcast_merge(materialise(first).rows, dims, keys)).rows
        smaller = materialise(_outside_of(left.rows, dims, keys, strongest))
        if smaller.count == left.count:
            break
        narrow = smaller.rows.select(*keys, *cells, *dims)
        again = cut_into_blocks(Phase(narrow, smaller.count), dims, keys, lead=[F.col(c) for c in cells])
        worthwhile = smaller.count <= WORTHWHILE * left.count
        left = Phase(again, smaller.count)
        if not worthwhile:
            break
    return left.rows


def _same_place(x: Sequence[Column], y: Sequence[Column], n_keys: int) -> Column:
    """Equality of key values (which may be null) and block numbers (which are not)."""
    keys = [i.eqNullSafe(j) for i, j in zip(x[:n_keys], y[:n_keys], strict=True)]
    return every(keys + [i == j for i, j in zip(x[n_keys:], y[n_keys:], strict=True)])


def _quantile_buckets(rows: DataFrame, dims: Sequence[str], blocks: int) -> list[Column]:
    """Per-dimension bucket numbers that make range partitions compact boxes."""
    slices = round(blocks ** (1 / len(dims)))
    if slices < 2:
        return []
    types = {f.name: f.dataType for f in rows.schema.fields}
    if not all(has_number(types[c]) for c in dims):
        return []
    numbers = rows.select(*[as_number(F.col(c), types[c]).alias(c) for c in dims])
    cuts = numbers.approxQuantile(list(dims), [i / slices for i in range(1, slices)], 0.01)
    buckets = []
    for c, bounds in zip(dims, cuts, strict=True):
        x = as_number(F.col(c), types[c])
        steps = [F.when(x > F.lit(v), 1).otherwise(0) for v in bounds]
        buckets.append(reduce(add, steps, F.lit(0)))
    return buckets
