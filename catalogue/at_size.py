"""Merges and filters in the form they take beyond what is broadcast; phases and grids of experiments."""

from __future__ import annotations

from functools import partial, reduce
from operator import and_

from pyspark.sql import functions as F

from catalogue.basics import points_sql, scaled_sql
from catalogue.registry import dominates, not_exists, register, table
from catalogue.skylines import (
    _LINE_TEST,
    _MIXED,
    _MIXED_ROWS,
    _MIXED_SKY,
    _XS4,
    LINE_ROWS,
    line,
    line_dims,
    mixed,
)
from pareto_frame import (
    STRATEGIES,
    compare_strategies,
    grid_of,
    run_grid,
    seeded_skyline,
    skyline,
    skyline_by,
    skyline_with_phases,
)
from pareto_frame.operators.boxes import box_merge
from pareto_frame.operators.joins import survivors_of_many
from pareto_frame.operators.states import merge_states, skyline_states, state_rows
from pareto_frame.session import materialise, scratch_path
from pareto_frame.sources.clustered import write_clustered
from pareto_frame.sources.generate import with_points

# merges by super-boxes


@register("G7_super_boxes", _MIXED_SKY)
def super_boxes(spark, folder):
    """All distinct tuples as candidates, in several super-boxes."""
    return box_merge(materialise(mixed(spark, folder).distinct()), _MIXED, box_rows=1_500)


_PRIORITY_ROWS = _MIXED_ROWS.replace("SELECT o_totalprice", "SELECT o_orderpriority, o_totalprice")


@register(
    "G7_super_boxes_by_key",
    f"""
    WITH o AS {_PRIORITY_ROWS} SELECT DISTINCT * FROM o p WHERE NOT EXISTS (
        SELECT 1 FROM o q WHERE q.o_orderpriority = p.o_orderpriority
        AND {dominates([f"q.{d}" for d in _MIXED], [f"p.{d}" for d in _MIXED])})
    """,
)
def super_boxes_by_key(spark, folder):
    """Groups that go on from one super-box to the next."""
    rows = table(spark, folder, "orders").select(
        "o_orderpriority",
        F.col("o_totalprice").alias("price"),
        (-F.col("o_custkey")).alias("customer"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("day"),
    )
    return box_merge(materialise(rows.distinct()), _MIXED, ["o_orderpriority"], box_rows=1_000)


@register("G4_lattice_minima", _MIXED_SKY)
def lattice_minima(spark, folder):
    """Local skylines of cells, refined by one summary of the cells below each."""
    return skyline(
        mixed(spark, folder), _MIXED, "grid_parallel", slices=6, ties="distinct", broadcast_rows=0
    )


def _line(strategy, spark, folder, **options):
    return skyline(line(spark, folder), line_dims(), strategy, **options)


for _name, _strategy, _options in [
    ("H13_grid_parallel_at_size", "grid_parallel", {"slices": 4, "broadcast_rows": 0}),
    ("H8_radius_angular_at_size", "radius_angular", {"broadcast_rows": 0}),
    ("H3_bnl_small_window", "bnl", {"window": 100}),
    ("skyline_auto_at_size", "auto", {"broadcast_rows": 0}),
]:
    register(_name, LINE_ROWS)(partial(_line, _strategy, **_options))


@register(
    "F6_skyline_by_at_size",
    f"""
    WITH best AS (
        SELECT l_returnflag, l_quantity, l_discount, l_tax, min(l_extendedprice) AS l_extendedprice
        FROM lineitem GROUP BY l_returnflag, l_quantity, l_discount, l_tax)
    SELECT l_returnflag, l_extendedprice, -l_quantity AS quantity, -l_discount AS discount, l_tax FROM best p
    WHERE NOT EXISTS (SELECT 1 FROM best q WHERE q.l_returnflag = p.l_returnflag AND {_LINE_TEST})
    """,
)
def skyline_by_at_size(spark, folder):
    dims = [
        "l_extendedprice",
        (-F.col("l_quantity")).alias("quantity"),
        (-F.col("l_discount")).alias("discount"),
        "l_tax",
    ]
    return skyline_by(table(spark, folder, "lineitem"), ["l_returnflag"], dims, broadcast_rows=0)


@register(
    "F6_mergeable_states",
    f"""
    WITH best AS (
        SELECT l_returnflag, l_quantity, l_discount, l_tax, min(l_extendedprice) AS l_extendedprice
        FROM lineitem GROUP BY l_returnflag, l_quantity, l_discount, l_tax)
    SELECT l_returnflag, l_extendedprice, 0 - l_quantity AS quantity, 0 - l_discount AS discount, l_tax FROM best p
    WHERE NOT EXISTS (SELECT 1 FROM best q WHERE q.l_returnflag = p.l_returnflag AND {_LINE_TEST})
    """,
)
def mergeable_states(spark, folder):
    """States by flag, status and supplier, merged to those by flag and status, and those to flags."""
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        "l_suppkey",
        "l_extendedprice",
        (0 - F.col("l_quantity")).alias("quantity"),
        (0 - F.col("l_discount")).alias("discount"),
        "l_tax",
    )
    names = ["l_extendedprice", "quantity", "discount", "l_tax"]
    dims = [rows.schema[c] for c in names]
    fine = skyline_states(rows, ["l_returnflag", "l_linestatus", "l_suppkey"], names)
    by_status = merge_states(fine, ["l_returnflag", "l_linestatus"], dims)
    return state_rows(merge_states(by_status, ["l_returnflag"], dims), ["l_returnflag"], dims)


# filters by many points

_KEYED_ROWS = _MIXED_ROWS.replace("SELECT o_totalprice", "SELECT o_orderkey, o_totalprice")


def _keyed(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        (-F.col("o_custkey")).alias("customer"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("day"),
    )


@register(
    "G2_filter_by_many_points",
    f"""
    WITH o AS {_KEYED_ROWS}, rivals AS (SELECT * FROM o WHERE o_orderkey % 2 = 1)
    SELECT * FROM o p WHERE {not_exists("rivals", _MIXED)}
    """,
)
def many_points(spark, folder):
    """Orders, with their key, that no order of an odd key beats."""
    rows = _keyed(spark, folder)
    rivals = materialise(rows.filter("o_orderkey % 2 = 1").select(*_MIXED))
    return survivors_of_many(rows, _MIXED, rivals, limit=0)


@register(
    "G6_many_seeds",
    f"""
    WITH o AS {_KEYED_ROWS}, seeds AS (SELECT * FROM o WHERE o_orderkey % 2 = 1)
    SELECT * FROM seeds
    UNION ALL SELECT * FROM o p WHERE o_orderkey % 2 = 0 AND {not_exists("o", _MIXED)}
    """,
)
def many_seeds(spark, folder):
    rows = _keyed(spark, folder)
    odd = F.col("o_orderkey") % 2 == 1
    return seeded_skyline(rows.filter(~odd), _MIXED, rows.filter(odd), broadcast_rows=0)



@register(
    "H10_given_at_size",
    f"""
    WITH o AS {_KEYED_ROWS}, given AS (SELECT price + 20000 AS price, customer + 30 AS customer, day + 100 AS day FROM o),
    kept AS (SELECT * FROM o p WHERE {not_exists("given", _MIXED)})
    SELECT * FROM kept p WHERE {not_exists("kept", _MIXED)}
    """,
)
def given_at_size(spark, folder):
    """As many given points as rows."""
    rows = _keyed(spark, folder)
    given = rows.select(
        (F.col("price") + 20000).alias("price"), (F.col("customer") + 30).alias("customer"), (F.col("day") + 100).alias("day")
    )
    return skyline(rows, _MIXED, "representatives", given=given, broadcast_rows=0)


# tables stored by cell


def _clustered(spark, folder):
    rows = line(spark, folder)
    return write_clustered(rows, line_dims(), scratch_path(spark, "clustered"), file_rows=2_000)


@register("G3_clustered_skyline", LINE_ROWS)
def clustered_skyline(spark, folder):
    """Files that a champion of another file rules out are not read."""
    return _clustered(spark, folder).skyline(line_dims())


@register(
    "F4_zone_map",
    """
    SELECT count(*) AS n_rows, min(l_extendedprice) AS low0, min(-l_quantity) AS low1, min(-l_discount) AS low2,
      min(l_tax) AS low3, true AS corners FROM lineitem
    """,
)
def zone_map(spark, folder):
    """The zone map covers every row, and no champion lies below its file's lower corner."""
    zones = _clustered(spark, folder).zones
    lows = [F.min(f"low{i}").alias(f"low{i}") for i in range(4)]
    above = [F.col(f"low{i}") <= F.col(f"best{i}") for i in range(4)]
    return zones.agg(F.sum("n_rows").alias("n_rows"), *lows, F.every(reduce(and_, above)).alias("corners"))


# phases and experiments


def _phases(strategy, spark, folder):
    """Exact sizes of input and result from the run itself, and whether what goes on shrinks."""
    _, phases = skyline_with_phases(mixed(spark, folder), _MIXED, strategy, ties="distinct")
    through = F.col("phase").isin("input", "first pass", "filtered", "local skylines", "skyline")
    rows = F.transform(F.array_sort(F.collect_list(F.when(through, F.struct("step", "n_rows")))), lambda x: x["n_rows"])
    return phases.agg(rows.alias("rows")).select(
        F.lit(strategy).alias("strategy"),
        F.element_at("rows", 1).alias("n_input"),
        F.element_at("rows", -1).alias("n_skyline"),
        (F.size("rows") > 2).alias("stored_phases"),
        (F.col("rows") == F.sort_array("rows", asc=False)).alias("shrinking"),
    )


for _strategy in ("sfs_range", "representatives", "three_phase"):
    register(
        f"F5_phases_{_strategy}",
        f"SELECT '{_strategy}' AS strategy, (SELECT count(*) FROM orders) AS n_input, "
        f"(SELECT count(*) FROM ({_MIXED_SKY})) AS n_skyline, true AS stored_phases, true AS shrinking",
    )(partial(_phases, _strategy))

_STRATEGY_NAMES = ", ".join(f"('{name}')" for name in STRATEGIES)


@register(
    "H16_cross_check_of_lineitem",
    f"""
    WITH best AS ({LINE_ROWS})
    SELECT strategy, (SELECT count(*) FROM best) AS n_rows, 0::BIGINT AS missing, 0::BIGINT AS surplus
    FROM (VALUES {_STRATEGY_NAMES}) s(strategy)
    """,
)
def cross_check_lineitem(spark, folder):
    """Every strategy over all of lineitem, with all ties, against the one without Python."""
    rows = line(spark, folder)
    n = skyline(rows, line_dims()).count()
    return compare_strategies(rows, line_dims()).select("strategy", F.lit(n).cast("long").alias("n_rows"), "missing", "surplus")


_SOURCES = [("supplier", "s_suppkey"), ("part", "p_partkey")]
_KINDS = [("independent", 10.0), ("correlated", 10.0), ("anti_correlated", 100.0)]


def _grid_sql(source, row_id, kind, spread):
    scaled = scaled_sql("t", [row_id], _XS4, half_open=True, per_dim=False)
    xs = ", ".join(f"s_{x} AS {x}" for x in _XS4)
    return f"""(WITH t AS ({points_sql(source, row_id, kind, spread=spread)}), u AS (SELECT {xs} FROM ({scaled}))
        SELECT count(*) FROM (SELECT DISTINCT * FROM u p WHERE {not_exists('u', _XS4)}))"""


@register(
    "H15_experiment_grid",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, (SELECT count(*) FROM {source}) AS n_input, strategy, 'half_open' AS scaling, "
        f"{_grid_sql(source, row_id, kind, spread)} AS size, true AS enough_candidates "
        "FROM (VALUES ('sfs_range'), ('representatives')) s(strategy)"
        for kind, spread in _KINDS
        for source, row_id in _SOURCES
    ),
)
def experiment_grid(spark, folder):
    """Three kinds of points over tables of growing size, scaled, by two strategies."""
    spreads = dict(_KINDS)

    def points(case):
        source, row_id = _SOURCES[case.n]
        ids = table(spark, folder, source).select(row_id)
        return with_points(ids, row_id, case.kind, spread=spreads[case.kind])

    cases = grid_of(spreads, range(len(_SOURCES)), [4], ["sfs_range", "representatives"], ["half_open"])
    enough = (F.col("candidates") >= F.col("size")).alias("enough_candidates")
    return run_grid(spark, cases, points).select("kind", "n_input", "strategy", "scaling", "size", enough)
