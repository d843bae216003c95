"""Dominance joins.

A theta anti-join in Spark ships its right side to every task, so each one here
takes a right side of known size: representatives and grid cells are bounded by
their parameters, everything else is counted first.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pareto_frame.functions.dominance import (
    cell_totally_dominates,
    every,
    strictly_dominates,
    weakly_dominates,
)
from pareto_frame.operators.boxes import not_dominated_by
from pareto_frame.operators.frequent import SALT, frequent, repeated, salted
from pareto_frame.operators.local import supports
from pareto_frame.session import Phase, default_partitions, materialise

# Beyond this many candidates super-boxes are faster than everyone against all (measured in 4 to 6 dimensions).
BROADCAST_ROWS = 40_000
SEMI_BROADCAST_VALUES = 4_000_000
# Text has no fixed width, so its bytes are counted.
TEXT_BYTES = 64 << 20
# However low the bound is set, shares of dominators are not smaller than this.
SHARE_ROWS = 10_000


def few_enough(phase: Phase, names: Sequence[str], limit: int) -> bool:
    """Whether a stored table may be broadcast: at most ``limit`` rows, and its texts at most TEXT_BYTES."""
    if phase.count > limit:
        return False
    if phase.text_bytes is not None:
        return phase.text_bytes <= TEXT_BYTES
    kinds = (T.StringType, T.BinaryType)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in names if isinstance(phase.rows.schema[c].dataType, kinds)]
    if not texts:
        return True
    total = phase.rows.agg(F.sum(sum(texts, F.lit(0).cast("long")))).first()[0]
    return (total or 0) <= TEXT_BYTES


def rival_names(dims: Sequence[str]) -> list[str]:
    return [f"__sky_q{i}" for i in range(len(dims))]


def as_rivals(rows: DataFrame, dims: Sequence[str], *extra: Column) -> DataFrame:
    """The dimension columns under names that cannot meet those of the other side."""
    renamed = [F.col(c).alias(q) for c, q in zip(dims, rival_names(dims), strict=True)]
    return rows.select(*renamed, *extra)


def columns(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def survivors(
    rows: DataFrame, dims: Sequence[str], rivals: DataFrame, weak: bool = False
) -> DataFrame:
    """Rows that no rival dominates; ``rivals`` must be small.

    ``weak`` also drops rows that equal a rival.
    """
    test = weakly_dominates if weak else strictly_dominates
    condition = test(columns(rival_names(dims)), columns(dims))
    return rows.join(F.broadcast(as_rivals(rivals, dims)), condition, "left_anti")


def survivors_of_many(
    rows: DataFrame, dims: Sequence[str], rivals: Phase, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """``survivors`` for any number of rivals.

    Up to ``limit`` an anti-join with all of them; beyond it, a pass against a packed tree, or for types
    without a 64-bit form anti-joins with shares of at most ``limit`` or ``SHARE_ROWS``.
    """
    if rivals.count <= limit:
        return survivors(rows, dims, rivals.rows)
    types = [(rows.schema[c].dataType, rivals.rows.schema[c].dataType) for c in dims]
    # 64-bit forms compare within one type only
    if all(p == q and supports(p) for p, q in types):
        return not_dominated_by(rows, dims, rivals)
    shares = max(1, ceil(rivals.count / max(SHARE_ROWS, limit)))
    share = F.pmod(F.xxhash64(*dims), F.lit(shares))
    for i in range(shares):
        rows = survivors(rows, dims, rivals.rows.filter(share == i))
    return rows


def minimal_partners(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Fewer rows with the same dominating power.

    Among rows that agree on all dimensions but the last, the one with the
    smallest last value beats everything that any of them beats.
    """
    *head, last = dims
    if not head:
        return rows.agg(F.min(last).alias(last)).filter(F.col(last).isNotNull())
    return rows.groupBy(*head).agg(F.min(last).alias(last))


def surviving_cells(
    cells: DataFrame, coordinates: Sequence[str], limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Occupied cells that no other occupied cell totally dominates.

    Up to ``limit`` cells that matter as dominators are shipped to every task; more are sent as a packed tree.
    """
    partners = materialise(minimal_partners(cells, coordinates))
    if partners.count > limit and all(isinstance(cells.schema[c].dataType, T.IntegralType) for c in coordinates):
        # smaller everywhere is the same as nowhere greater after one step up
        stepped = [(F.col(c) + 1).cast(cells.schema[c].dataType).alias(c) for c in coordinates]
        rivals = Phase(partners.rows.select(*stepped), partners.count)
        return not_dominated_by(cells, coordinates, rivals, strict=False)
    condition = cell_totally_dominates(columns(rival_names(coordinates)), columns(coordinates))
    shares = max(1, ceil(partners.count / max(SHARE_ROWS, limit)))
    share = F.pmod(F.xxhash64(*coordinates), F.lit(shares))
    for i in range(shares):
        rivals = as_rivals(partners.rows.filter(share == i), coordinates)
        cells = cells.join(F.broadcast(rivals), condition, "left_anti")
    return cells


def matching_rows(
    df: DataFrame,
    exprs: Sequence[Column],
    tuples: DataFrame,
    names: Sequence[str],
    at_most: int | None,
) -> DataFrame:
    """All rows of ``df`` whose values are among ``tuples``; null equals null.

    ``at_most`` bounds the number of tuples; without it they are counted. The input is read
    again to find its rows by value, so it has to give the same values each time.

    Beyond the broadcast bound one tuple may still hold a large share of the rows, so a sketch finds the
    frequent ones; their rows are salted, and only they are repeated on the other side.
    """
    bound = SEMI_BROADCAST_VALUES // len(names)
    wide = any(isinstance(tuples.schema[n].dataType, (T.StringType, T.BinaryType)) for n in names)
    few = at_most is not None and at_most <= bound
    if wide or not few:
        phase = materialise(tuples)
        tuples, few = phase.rows, few_enough(phase, names, bound)
    same = every([e.eqNullSafe(F.col(n)) for e, n in zip(exprs, names, strict=True)])
    if few:
        return df.join(F.broadcast(tuples), same, "left_semi")
    hot = materialise(frequent(df, exprs, default_partitions(df))).rows
    copies = repeated(tuples, names, hot).withColumnRenamed(SALT, "__sky_salt_of_tuple")
    same = same & (F.col(SALT) == F.col("__sky_salt_of_tuple"))
    return salted(df, exprs, hot).join(copies, same, "left_semi").drop(SALT)
