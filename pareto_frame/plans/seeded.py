"""A skyline that starts from rows known to belong to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pareto_frame.functions.dominance import every, some
from pareto_frame.operators.cleaning import quoted
from pareto_frame.operators.joins import BROADCAST_ROWS, matching_rows
from pareto_frame.plans.skyline import first_of_each, resolve_dims, skyline


def seeded_skyline(
    df: DataFrame,
    dims: Sequence[str | Column],
    seed: DataFrame,
    strategy: str = "auto",
    *,
    ties: str = "all",
    nulls: str = "drop",
    tie_break: Sequence[str | Column] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    **options,
) -> DataFrame:
    """``seed`` and the rows of ``df`` that neither it nor other rows dominate.

    Both have the same columns. Seed rows always stay, even when a row of ``df``
    dominates them, and those with a null dimension too. ``ties``, ``nulls`` and
    ``tie_break`` mean for the rows of ``df`` what they mean in ``skyline``; with
    ``ties="distinct"`` rows that equal a seed row, also in null dimensions, add nothing,
    and ``tie_break`` picks among equal seed rows as well.

    Seeds and rows compete as tuples in one skyline, whatever their numbers: seeds meet
    only what a local pass leaves of the rows.
    """
    names, exprs = resolve_dims(df, dims)
    xs = [f"__sky_s{i}" for i in range(len(exprs))]
    as_tuples = [e.alias(x) for e, x in zip(exprs, xs, strict=True)]
    narrow, known = df.select(*as_tuples), seed.select(*as_tuples).distinct()
    winners = skyline(
        narrow.unionByName(known),
        xs,
        strategy,
        ties="distinct",
        nulls=nulls,
        broadcast_rows=broadcast_rows,
        **options,
    )
    if ties == "all":
        complete = winners.filter(every([F.col(x).isNotNull() for x in xs]))
        added = matching_rows(df, exprs, complete, xs, None)
        if nulls == "keep":
            added = added.unionByName(df.filter(some([e.isNull() for e in exprs])))
        return seed.unionByName(added)
    theirs = [F.col(x).alias(f"{x}_known") for x in xs]
    equal = [F.col(x).eqNullSafe(F.col(f"{x}_known")) for x in xs]
    fresh = winners.join(known.select(*theirs), every(equal), "left_anti")
    if not tie_break:
        both = known.unionByName(fresh)
        return both.select(*[F.col(x).alias(n) for x, n in zip(xs, names, strict=True)])
    complete = fresh.filter(every([F.col(x).isNotNull() for x in xs]))
    added = first_of_each(matching_rows(df, exprs, complete, xs, None), exprs, tie_break)
    if nulls == "keep":
        incomplete = df.filter(some([e.isNull() for e in exprs]))
        same = [e.eqNullSafe(F.col(f"{x}_known")) for e, x in zip(exprs, xs, strict=True)]
        added = added.unionByName(incomplete.join(known.select(*theirs), every(same), "left_anti"))
    columns = [quoted(c) for c in seed.columns]
    return first_of_each(seed, exprs, tie_break).select(*columns).unionByName(added)
