"""One skyline per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pareto_frame.functions.dominance import every, some
from pareto_frame.operators.aggregates import skyline_aggregate
from pareto_frame.operators.cleaning import quoted
from pareto_frame.operators.joins import BROADCAST_ROWS, matching_rows
from pareto_frame.operators.local import local_skyline, supports
from pareto_frame.operators.merge import global_skyline
from pareto_frame.plans.skyline import first_of_each, resolve_dims
from pareto_frame.session import default_partitions, materialise


def skyline_by(
    df: DataFrame,
    keys: Sequence[str],
    dims: Sequence[str | Column],
    strategy: str = "auto",
    *,
    ties: str = "distinct",
    nulls: str = "drop",
    tie_break: Sequence[str | Column] | None = None,
    partitions: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The skyline of every group; rows of a null key form groups of their own.

    With ``ties="distinct"`` the distinct tuples come, ``keys`` and dimensions, or with
    ``tie_break`` one whole row per group and tuple; with ``"all"`` every row with all its
    columns. ``nulls`` means what it means in ``skyline``.

    ``"auto"`` runs local passes with the group as a condition, before and
    after a shuffle over keys and dimensions, so a large group is spread over
    all tasks; candidates then meet in a join on the keys. ``"aggregate"`` folds
    partial skylines as lists instead.
    """
    if ties not in ("all", "distinct") or nulls not in ("drop", "keep"):
        raise ValueError("ties is 'all' or 'distinct', nulls is 'drop' or 'keep'")
    names, exprs = resolve_dims(df, dims)
    xs = [f"__sky_x{i}" for i in range(len(exprs))]
    ks = [f"__sky_k{i}" for i in range(len(keys))]
    tagged = df.select(
        *[quoted(k).alias(c) for k, c in zip(keys, ks, strict=True)],
        *[e.alias(x) for e, x in zip(exprs, xs, strict=True)],
    )
    complete = every([F.col(x).isNotNull() for x in xs])
    narrow = tagged.filter(complete)
    types = [f.dataType for f in narrow.schema.fields[len(keys) :]]
    if not all(supports(t) for t in types):
        merged = global_skyline(materialise(narrow.distinct()), xs, ks, broadcast_rows)
    else:
        local = local_skyline(narrow, xs, ks)
        if strategy == "aggregate":
            merged = skyline_aggregate(local, xs, ks, limit=broadcast_rows)
        elif strategy == "auto":
            n = partitions or default_partitions(df)
            laid = local.repartition(n, *ks, *xs)
            laid = laid.sortWithinPartitions(*ks)
            candidates = materialise(local_skyline(laid, xs, ks, by_key=True))
            merged = global_skyline(candidates, xs, ks, broadcast_rows)
        else:
            raise ValueError("strategy is 'auto' or 'aggregate'")
    if ties == "distinct" and not tie_break:
        if nulls == "keep":
            merged = merged.unionByName(tagged.filter(~complete).distinct())
        back = [*zip(ks, keys, strict=True), *zip(xs, names, strict=True)]
        return merged.select(*[F.col(c).alias(n) for c, n in back])
    places = [*[quoted(k) for k in keys], *exprs]
    rows = matching_rows(df, places, merged, [*ks, *xs], None)
    if ties == "distinct":
        rows = first_of_each(rows, places, tie_break)
    if nulls == "keep":
        rows = rows.unionByName(df.filter(some([e.isNull() for e in exprs])))
    return rows
