"""Dominance joins, strategies, groups and jobs."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.basics import (
    MEASURES,
    _SCALED,
    _SX,
    _XS,
    _coordinate_sql,
    _scaled,
    points_sql,
    representatives_sql,
    representatives,
)
from catalogue.registry import dominates, not_exists, register, table
from pareto_frame import (
    STRATEGIES,
    compare_strategies,
    seeded_skyline,
    skyline,
    skyline_by,
    sweep_sizes,
)
from pareto_frame.functions.geometry import cell_id, grid_coordinates
from pareto_frame.operators.cleaning import normalise
from pareto_frame.operators.aggregates import occupied_cells
from pareto_frame.operators.joins import surviving_cells, survivors
from pareto_frame.operators.merge import (
    block_merge,
    cut_into_blocks,
    global_skyline,
    sweep_merge,
)
from pareto_frame.session import materialise
from pareto_frame.sources.generate import with_points
from pareto_frame.sources.rows import from_rows

# Inputs

PART = ["p_partkey", "p_size", "p_retailprice"]
PART_DIMS = ["p_size", "p_retailprice"]
ORDER_DIMS = ["o_totalprice", "o_orderdate"]


def part(spark, folder):
    return table(spark, folder, "part").select(*PART)


def orders(spark, folder):
    return table(spark, folder, "orders")


def line(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *MEASURES)


def line_dims():
    """Cheap, many, much discount, little tax."""
    return ["l_extendedprice", -F.col("l_quantity"), -F.col("l_discount"), "l_tax"]


_LINE_TEST = (
    "q.l_extendedprice <= p.l_extendedprice AND q.l_quantity >= p.l_quantity "
    "AND q.l_discount >= p.l_discount AND q.l_tax <= p.l_tax "
    "AND (q.l_extendedprice < p.l_extendedprice OR q.l_quantity > p.l_quantity "
    "OR q.l_discount > p.l_discount OR q.l_tax < p.l_tax)"
)

# Of rows that agree on three dimensions only the cheapest matter as dominators.
LINE_TUPLES = f"""
    WITH best AS (
        SELECT l_quantity, l_discount, l_tax, min(l_extendedprice) AS l_extendedprice
        FROM lineitem GROUP BY l_quantity, l_discount, l_tax),
    tuples AS (
        SELECT * FROM best p WHERE NOT EXISTS (SELECT 1 FROM best q WHERE {_LINE_TEST}))
"""
LINE_ROWS = f"""{LINE_TUPLES}
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
    FROM lineitem JOIN tuples USING (l_quantity, l_discount, l_tax, l_extendedprice)
"""
PART_SQL = f"SELECT {', '.join(PART)} FROM part p WHERE {not_exists('part', PART_DIMS)}"
ORDERS_SQL = (
    "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders p "
    f"WHERE {not_exists('orders', ORDER_DIMS)}"
)

# G. joins and set operations


@register("G1_not_exists", ORDERS_SQL)
def anti_join(spark, folder):
    rows = orders(spark, folder).select("o_orderkey", *ORDER_DIMS)
    return skyline(rows, ORDER_DIMS, "sql")


@register(
    "G2_representative_filter",
    f"""
    WITH reps AS ({representatives_sql("lineitem", MEASURES, 10)})
    SELECT l_orderkey, l_linenumber, {", ".join(MEASURES)} FROM lineitem p
    WHERE {not_exists("reps", MEASURES)}
    """,
)
def representative_filter(spark, folder):
    reps = materialise(representatives(spark, folder).select(*MEASURES).distinct())
    return survivors(line(spark, folder), MEASURES, reps.rows)


_C8 = [_coordinate_sql(s, 8) for s in _SX]
_C8_NAMES = ["c0", "c1", "c2"]
_CELL_ROWS = (
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{c} AS {n}" for c, n in zip(_C8, _C8_NAMES, strict=True))
    + f" FROM {_SCALED}"
)


@register(
    "G3_cell_filter",
    f"""
    WITH placed AS ({_CELL_ROWS}),
    cells AS (SELECT DISTINCT c0, c1, c2 FROM placed)
    SELECT * FROM placed p WHERE NOT EXISTS (
        SELECT 1 FROM cells q WHERE q.c0 < p.c0 AND q.c1 < p.c1 AND q.c2 < p.c2)
    """,
)
def cell_filter(spark, folder):
    coordinates = grid_coordinates([F.col(x) for x in _XS], 8)
    named = [c.alias(n) for c, n in zip(coordinates, _C8_NAMES, strict=True)]
    placed = _scaled(spark, folder).select("l_orderkey", "l_linenumber", *named)
    # at most 8 ** 3 cells
    alive = surviving_cells(occupied_cells(placed, _C8_NAMES), _C8_NAMES)
    return placed.join(F.broadcast(alive), _C8_NAMES, "left_semi")


_MIXED = ["price", "customer", "day"]
_MIXED_ROWS = """
    (SELECT o_totalprice AS price, -o_custkey AS customer,
            CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day
     FROM orders)
"""
_MIXED_SKY = f"""
    WITH o AS {_MIXED_ROWS} SELECT DISTINCT * FROM o p WHERE {not_exists("o", _MIXED)}
"""


def mixed(spark, folder):
    return orders(spark, folder).select(
        F.col("o_totalprice").alias("price"),
        (-F.col("o_custkey")).alias("customer"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("day"),
    )


@register("G4_cross_cell_refinement", _MIXED_SKY)
def cross_cell(spark, folder):
    """Local skylines of grid cells, refined by the cells that may dominate them."""
    names = ["c0", "c1", "c2"]
    scaled = [f"s_{d}" for d in _MIXED]
    copies = {s: F.col(d).cast("double") for s, d in zip(scaled, _MIXED, strict=True)}
    rows = normalise(mixed(spark, folder).withColumns(copies), scaled, True, True)
    coordinates = grid_coordinates([F.col(s) for s in scaled], 4)
    placed = rows.select(*_MIXED, *[c.alias(n) for c, n in zip(coordinates, names, strict=True)])
    local = materialise(skyline_by(placed, names, _MIXED))
    cell = cell_id([F.col(n) for n in names], 4)
    return block_merge(cut_into_blocks(local, _MIXED, lead=[cell]), _MIXED, cells=names)


@register("G5_union_of_partial_skylines", LINE_ROWS)
def union_of_parts(spark, folder):
    rows = table(spark, folder, "lineitem")
    kept = ["l_orderkey", "l_linenumber", *MEASURES]
    first = F.col("l_linestatus").eqNullSafe("F")
    halves = [
        skyline(rows.filter(condition).select(*kept), line_dims())
        for condition in (first, ~first)
    ]
    return skyline(halves[0].unionByName(halves[1]), line_dims())


_SEED = [(-1, 3, 905.0), (-2, 10, 901.0)]
_SEED_SQL = f"seed(p_partkey, p_size, p_retailprice) AS (VALUES {str(_SEED)[1:-1]})"


@register(
    "G6_seeded",
    f"""
    WITH {_SEED_SQL},
    rest AS (SELECT {", ".join(PART)} FROM part p WHERE {not_exists("seed", PART_DIMS)})
    SELECT * FROM seed UNION ALL SELECT * FROM rest p WHERE {not_exists("rest", PART_DIMS)}
    """,
)
def seeded(spark, folder):
    seed = from_rows(spark, _SEED, "p_partkey bigint, p_size int, p_retailprice double")
    return seeded_skyline(part(spark, folder), PART_DIMS, seed)


# Seeds with nulls, copies, and tuples that the rows have too; part has no null, so sizes divisible by 7 count as null.
_ODD_SEED = [(-1, 3, 905.0), (-2, None, 901.0), (-3, None, 901.0), (-4, 50, None), (-5, 3, 905.0)]
_ODD_PART = "(SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_size END AS p_size, p_retailprice FROM part)"
_ODD_SEED_SQL = "seed(p_partkey, p_size, p_retailprice) AS (VALUES " + str(_ODD_SEED)[1:-1].replace("None", "NULL") + ")"
_SEEDED_NULLS = f"""
    WITH {_ODD_SEED_SQL}, odd AS {_ODD_PART}, rivals AS (SELECT * FROM odd UNION ALL SELECT * FROM seed)
    SELECT * FROM seed UNION ALL
    SELECT * FROM odd p WHERE p_size IS NULL OR p_retailprice IS NULL OR {not_exists("rivals", PART_DIMS)}
"""


def _odd(spark, folder):
    size = F.when(F.col("p_size") % 7 > 0, F.col("p_size"))
    seed = from_rows(spark, _ODD_SEED, "p_partkey bigint, p_size int, p_retailprice double")
    return part(spark, folder).withColumn("p_size", size), seed


@register("G6_seeded_nulls", _SEEDED_NULLS)
def seeded_nulls(spark, folder):
    rows, seed = _odd(spark, folder)
    return seeded_skyline(rows, PART_DIMS, seed, nulls="keep")


@register("G6_seeded_nulls_joined", _SEEDED_NULLS)
def seeded_nulls_joined(spark, folder):
    rows, seed = _odd(spark, folder)
    return seeded_skyline(rows, PART_DIMS, seed, nulls="keep", broadcast_rows=0)


@register(
    "G6_seeded_distinct_nulls",
    f"""
    WITH {_ODD_SEED_SQL}, odd AS {_ODD_PART}, rivals AS (SELECT * FROM odd UNION ALL SELECT * FROM seed)
    SELECT DISTINCT p_size, p_retailprice FROM (SELECT * FROM seed UNION ALL
    SELECT * FROM odd p WHERE p_size IS NULL OR p_retailprice IS NULL OR {not_exists("rivals", PART_DIMS)})
    """,
)
def seeded_distinct_nulls(spark, folder):
    rows, seed = _odd(spark, folder)
    return seeded_skyline(rows, PART_DIMS, seed, nulls="keep", ties="distinct")


@register(
    "G6_seeded_expression",
    f"""
    WITH {_SEED_SQL}, rivals AS (SELECT *, 0 - p_size AS size FROM (SELECT {", ".join(PART)} FROM part UNION ALL SELECT * FROM seed)),
    mine AS (SELECT {", ".join(PART)}, 0 - p_size AS size FROM part)
    SELECT * FROM seed UNION ALL SELECT * EXCLUDE (size) FROM mine p
    WHERE {not_exists("rivals", ["size", "p_retailprice"])}
    """,
)
def seeded_expression(spark, folder):
    seed = from_rows(spark, _SEED, "p_partkey bigint, p_size int, p_retailprice double")
    dims = [0 - F.col("p_size"), "p_retailprice"]
    return seeded_skyline(part(spark, folder), dims, seed, broadcast_rows=0)


@register(
    "G6_seeded_first_of_each",
    f"""
    WITH {_SEED_SQL}, rows AS (SELECT p_partkey, p_size, floor(p_retailprice / 100) AS p_retailprice FROM part),
    rivals AS (SELECT * FROM rows UNION ALL SELECT * FROM seed)
    SELECT * FROM seed UNION ALL SELECT max(p_partkey) AS p_partkey, p_size, p_retailprice FROM rows p
    WHERE {not_exists("rivals", PART_DIMS)} GROUP BY p_size, p_retailprice
    """,
)
def seeded_first(spark, folder):
    seed = from_rows(spark, _SEED, "p_partkey bigint, p_size int, p_retailprice double")
    rows = part(spark, folder).withColumn("p_retailprice", F.floor(F.col("p_retailprice") / 100).cast("double"))
    return seeded_skyline(rows, PART_DIMS, seed, ties="distinct", tie_break=[-F.col("p_partkey")])


@register("G7_parallel_merge", _MIXED_SKY)
def parallel_merge(spark, folder):
    """Local skylines per priority, each tested against all of them."""
    rows = mixed(spark, folder).withColumn("slice", F.pmod(F.xxhash64(*_MIXED), F.lit(5)))
    local = skyline_by(rows, ["slice"], _MIXED).select(*_MIXED)
    return global_skyline(materialise(local), _MIXED)


@register("G7_block_merge", _MIXED_SKY)
def merge_by_blocks(spark, folder):
    """The same merge when the candidates are too many to ship."""
    everything = materialise(mixed(spark, folder).distinct())
    return block_merge(cut_into_blocks(everything, _MIXED), _MIXED)


@register(
    "G7_two_dimensional_sweep",
    f"SELECT DISTINCT o_totalprice, o_orderdate FROM orders p "
    f"WHERE {not_exists('orders', ORDER_DIMS)}",
)
def merge_by_sweep(spark, folder):
    everything = orders(spark, folder).select(*ORDER_DIMS).distinct()
    return sweep_merge(materialise(everything), ORDER_DIMS)


# H. strategies, all over the whole of lineitem


def _line_skyline(strategy, spark, folder, **options):
    return skyline(line(spark, folder), line_dims(), strategy, **options)


for _name, _strategy, _options in [
    ("H1_sql", "sql", {}),
    ("H2_nested_loop", "nested_loop", {}),
    ("H3_bnl", "bnl", {}),
    ("H4_sfs", "sfs", {}),
    ("H5_sfs_range", "sfs_range", {}),
    ("H6_sfs_random", "sfs_random", {}),
    ("H7_angular", "angular", {}),
    ("H8_radius_angular", "radius_angular", {}),
    ("H9_grid_filter", "grid_filter", {"slices": 8}),
    ("H10_representatives", "representatives", {}),
    ("H11_three_phase", "three_phase", {}),
    ("H12_grid", "grid", {}),
    ("H13_grid_parallel", "grid_parallel", {"slices": 4}),
    ("H14_aggregate", "aggregate", {}),
    ("skyline_auto", "auto", {}),
]:
    register(_name, LINE_ROWS)(partial(_line_skyline, _strategy, **_options))

_DISTINCT_LINE = f"""{LINE_TUPLES}
    SELECT l_extendedprice, 0 - l_quantity AS quantity, 0 - l_discount AS discount, l_tax
    FROM tuples
"""


def _distinct_line(strategy, spark, folder):
    dims = [
        "l_extendedprice",
        (0 - F.col("l_quantity")).alias("quantity"),
        (0 - F.col("l_discount")).alias("discount"),
        "l_tax",
    ]
    return skyline(line(spark, folder), dims, strategy, ties="distinct")


for _strategy in ("sql", "sfs_range", "grid_parallel"):
    register(f"ties_distinct_{_strategy}", _DISTINCT_LINE)(partial(_distinct_line, _strategy))

register("H1_sql_part", PART_SQL)(
    lambda spark, folder: skyline(part(spark, folder), PART_DIMS, "sql")
)


@register("skyline_orders_time", ORDERS_SQL)
def orders_2d(spark, folder):
    """A time as dimension."""
    return skyline(orders(spark, folder).select("o_orderkey", *ORDER_DIMS), ORDER_DIMS)


@register(
    "H10_given_representatives",
    ORDERS_SQL,
)
def given_representatives(spark, folder):
    """Representatives supplied by the caller: the cheapest order of each day."""
    rows = orders(spark, folder).select("o_orderkey", *ORDER_DIMS)
    given = rows.groupBy("o_orderdate").agg(F.min("o_totalprice").alias("o_totalprice"))
    given = given.select(*ORDER_DIMS)
    return skyline(rows, ORDER_DIMS, "representatives", given=given)


@register(
    "H10_given_one_dimension",
    "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice = (SELECT min(p_retailprice) FROM part)"
    " AND p_retailprice <= 900.5",
)
def given_one_dimension(spark, folder):
    """A supplied point that is not in the data beats every row that is worse."""
    rows = part(spark, folder).select("p_partkey", "p_retailprice")
    given = from_rows(spark, [(900.5,)], "price double")
    return skyline(rows, ["p_retailprice"], "representatives", given=given)


_TEXT_DIMS = ["p_brand", "p_type"]
_GIVEN_TEXT = [("Brand#2", "AAA")]


@register(
    "H10_given_text",
    f"""
    WITH given(p_brand, p_type) AS (VALUES {str(_GIVEN_TEXT)[1:-1]}),
    rest AS (SELECT p_partkey, p_brand, p_type FROM part p WHERE {not_exists("given", _TEXT_DIMS)})
    SELECT * FROM rest p WHERE {not_exists("rest", _TEXT_DIMS)}
    """,
)
def given_text(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", *_TEXT_DIMS)
    given = from_rows(spark, _GIVEN_TEXT, "brand string, type string")
    return skyline(rows, _TEXT_DIMS, "representatives", given=given)


_BY_DAY = ["o_totalprice", "o_custkey"]
_BY_DAY_ROWS = (
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority, o_totalprice, o_custkey FROM orders)"
)


def _odd_groups(spark, folder):
    """Orders with a null and a dotted group name."""
    key = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("by.priority")
    return orders(spark, folder).select("o_orderkey", key, *_BY_DAY)


@register(
    "F6_skyline_by_all_rows",
    f"""
    WITH o AS {_BY_DAY_ROWS} SELECT o_orderkey, priority, o_totalprice, o_custkey FROM o p
    WHERE NOT EXISTS (SELECT 1 FROM o q WHERE q.priority IS NOT DISTINCT FROM p.priority
      AND {dominates([f"q.{d}" for d in _BY_DAY], [f"p.{d}" for d in _BY_DAY])})
    """,
)
def by_group_all(spark, folder):
    rows = skyline_by(_odd_groups(spark, folder), ["by.priority"], _BY_DAY, ties="all")
    return rows.withColumnRenamed("by.priority", "priority")


# many dimensions: all of them take part in every key

_WIDE = 10
_WIDE_DIMS = [f"v{i}" for i in range(_WIDE)]
_WIDE_ROWS = (
    "(SELECT vec_id, "
    + ", ".join(f"floor(embedding[{i + 1}]::DOUBLE * 8)::BIGINT AS v{i}" for i in range(_WIDE))
    + " FROM embeddings)"
)


def _wide(strategy, spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        *[
            F.floor(F.get("embedding", F.lit(i)).cast("double") * 8).cast("bigint").alias(f"v{i}")
            for i in range(_WIDE)
        ],
    )
    return skyline(rows, _WIDE_DIMS, strategy)


for _number, _strategy in [
    (7, "angular"), (9, "grid_filter"), (10, "representatives"), (11, "three_phase"), (12, "grid"), (13, "grid_parallel"),
]:
    register(
        f"H{_number}_{_strategy}_10_dimensions",
        f"WITH w AS {_WIDE_ROWS} SELECT * FROM w p WHERE {not_exists('w', _WIDE_DIMS)}",
    )(partial(_wide, _strategy))


# ties

_BUCKETED = "(SELECT p_partkey, p_size, CAST(floor(p_retailprice / 100) AS BIGINT) AS step FROM part)"


def bucketed(spark, folder):
    step = F.floor(F.col("p_retailprice") / 100).alias("step")
    return part(spark, folder).select("p_partkey", "p_size", step)


@register(
    "ties_all",
    f"WITH t AS {_BUCKETED} SELECT * FROM t p WHERE {not_exists('t', ['p_size', 'step'])}",
)
def ties_all(spark, folder):
    return skyline(bucketed(spark, folder), ["p_size", "step"], "bnl")


@register(
    "ties_distinct",
    f"WITH t AS {_BUCKETED} SELECT DISTINCT p_size, step FROM t p "
    f"WHERE {not_exists('t', ['p_size', 'step'])}",
)
def ties_distinct(spark, folder):
    return skyline(bucketed(spark, folder), ["p_size", "step"], ties="distinct")


@register(
    "ties_first_of_each",
    f"WITH t AS {_BUCKETED} SELECT max(p_partkey) AS p_partkey, p_size, step FROM t p "
    f"WHERE {not_exists('t', ['p_size', 'step'])} GROUP BY p_size, step",
)
def ties_first(spark, folder):
    rows = bucketed(spark, folder)
    return skyline(rows, ["p_size", "step"], ties="distinct", tie_break=[-F.col("p_partkey")])


@register(
    "nulls_keep",
    f"""
    WITH t AS (SELECT p_partkey, nullif(p_size, 1) AS p_size, p_retailprice FROM part)
    SELECT * FROM t p WHERE {not_exists("t", PART_DIMS)}
    """,
)
def nulls_keep(spark, folder):
    """Rows with a null dimension neither dominate nor are dominated."""
    size = F.nullif(F.col("p_size"), F.lit(1)).alias("p_size")
    rows = table(spark, folder, "part").select("p_partkey", size, "p_retailprice")
    return skyline(rows, PART_DIMS, nulls="keep")


# after aggregation, mixed types, many dimensions, negative values


def _register_stats(name, source, columns, sql, build, strategy="auto"):
    dims = columns[1:]
    shown = ", ".join(columns)
    text = f"WITH t AS ({sql}) SELECT {shown} FROM t p WHERE {not_exists('t', dims)}"

    @register(name, text)
    def stats(spark, folder):
        return skyline(build(table(spark, folder, source)), dims, strategy)


_register_stats(
    "skyline_part_stats",
    "lineitem",
    ["l_partkey", "price", "quantity", "discount", "tax"],
    "SELECT l_partkey, min(l_extendedprice) AS price, -sum(l_quantity) AS quantity, "
    "-max(l_discount) AS discount, min(l_tax) AS tax FROM lineitem GROUP BY l_partkey",
    lambda t: t.groupBy("l_partkey").agg(
        F.min("l_extendedprice").alias("price"),
        (-F.sum("l_quantity")).alias("quantity"),
        (-F.max("l_discount")).alias("discount"),
        F.min("l_tax").alias("tax"),
    ),
)
_register_stats(
    "skyline_customer_stats",
    "orders",
    ["o_custkey", "price", "first", "n"],
    "SELECT o_custkey, min(o_totalprice) AS price, min(o_orderdate) AS first, -count(*) AS n "
    "FROM orders GROUP BY o_custkey",
    lambda t: t.groupBy("o_custkey").agg(
        F.min("o_totalprice").alias("price"),
        F.min("o_orderdate").alias("first"),
        (-F.count(F.lit(1))).alias("n"),
    ),
    "angular",
)
_register_stats(
    "skyline_supplier_stats",
    "lineitem",
    ["l_suppkey", "price", "quantity", "discount", "tax", "n"],
    "SELECT l_suppkey, min(l_extendedprice) AS price, -sum(l_quantity) AS quantity, "
    "-round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax, "
    "count(*) AS n FROM lineitem GROUP BY l_suppkey",
    lambda t: t.groupBy("l_suppkey").agg(
        F.min("l_extendedprice").alias("price"),
        (-F.sum("l_quantity")).alias("quantity"),
        (-F.round(F.avg("l_discount"), 6)).alias("discount"),
        F.round(F.avg("l_tax"), 6).alias("tax"),
        F.count(F.lit(1)).alias("n"),
    ),
    "sfs_range",
)
_register_stats(
    "skyline_event_users",
    "events",
    ["user_id", "low", "n", "high"],
    "SELECT user_id, min(value) AS low, -count(*) AS n, max(value) AS high "
    "FROM events GROUP BY user_id",
    lambda t: t.groupBy("user_id").agg(
        F.min("value").alias("low"),
        (-F.count(F.lit(1))).alias("n"),
        F.max("value").alias("high"),
    ),
    "aggregate",
)
_register_stats(
    "skyline_embedding_elements",
    "embeddings",
    ["vec_id", "a", "b", "c"],
    "SELECT vec_id, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c FROM embeddings",
    lambda t: t.select(
        "vec_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate("abc")]
    ),
    "grid_parallel",
)

# groups

_BY_PRIORITY = f"""
    WITH best AS (
        SELECT o_orderpriority, o_orderdate, min(o_totalprice) AS o_totalprice
        FROM orders GROUP BY o_orderpriority, o_orderdate),
    earlier AS (
        SELECT *, min(o_totalprice) OVER (
            PARTITION BY o_orderpriority ORDER BY o_orderdate
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM best)
    SELECT o_orderpriority, o_totalprice, o_orderdate FROM earlier
    WHERE before IS NULL OR o_totalprice < before
"""


@register("F6_skyline_per_group", _BY_PRIORITY)
def per_group(spark, folder):
    return skyline_by(orders(spark, folder), ["o_orderpriority"], ORDER_DIMS)


@register("F6_skyline_aggregate", _BY_PRIORITY)
def per_group_folded(spark, folder):
    return skyline_by(orders(spark, folder), ["o_orderpriority"], ORDER_DIMS, "aggregate")


@register(
    "F6_skyline_per_customer",
    f"""
    SELECT DISTINCT o_custkey, o_totalprice, o_orderdate FROM orders p
    WHERE NOT EXISTS (SELECT 1 FROM orders q WHERE q.o_custkey = p.o_custkey
        AND {dominates([f"q.{d}" for d in ORDER_DIMS], [f"p.{d}" for d in ORDER_DIMS])})
    """,
)
def per_customer(spark, folder):
    """Many small groups."""
    return skyline_by(orders(spark, folder), ["o_custkey"], ORDER_DIMS)


# generated points, one per order

_XS4 = ["x0", "x1", "x2", "x3"]


def _generated_sql(source, row_id, kind, spread):
    points = points_sql(source, row_id, kind, spread=spread)
    return f"WITH t AS ({points}) SELECT * FROM t p WHERE {not_exists('t', _XS4)}"


def _generated(kind, spread, strategy, spark, folder, **options):
    ids = table(spark, folder, "orders").select("o_orderkey")
    points = with_points(ids, "o_orderkey", kind, spread=spread)
    return skyline(points, _XS4, strategy, **options)


for _name, _kind, _spread, _strategy in [
    ("H5_independent_points", "independent", 10.0, "sfs_range"),
    ("H5_correlated_points", "correlated", 10.0, "sfs_range"),
    ("H5_anti_correlated_points", "anti_correlated", 100.0, "sfs_range"),
    ("H7_anti_correlated_points", "anti_correlated", 100.0, "angular"),
    ("H8_anti_correlated_points", "anti_correlated", 100.0, "radius_angular"),
    ("H10_anti_correlated_points", "anti_correlated", 100.0, "representatives"),
    ("H13_anti_correlated_points", "anti_correlated", 100.0, "grid_parallel"),
]:
    register(_name, _generated_sql("orders", "o_orderkey", _kind, _spread))(
        partial(_generated, _kind, _spread, _strategy)
    )

# jobs

_SWEEP = [
    ("supplier", "s_suppkey"),
    ("customer", "c_custkey"),
    ("part", "p_partkey"),
    ("orders", "o_orderkey"),
]
_SWEEP_SQL = " UNION ALL ".join(
    f"SELECT '{source}' AS input, strategy, (SELECT count(*) FROM {source}) AS n, "
    f"(SELECT count(*) FROM (SELECT DISTINCT x0, x1, x2, x3 FROM "
    f"({_generated_sql(source, key, 'anti_correlated', 100.0)}))) AS size "
    "FROM (VALUES ('sfs_range'), ('representatives')) s(strategy)"
    for source, key in _SWEEP
)


@register("H15_size_sweep", _SWEEP_SQL)
def sweep(spark, folder):
    """Skyline sizes over tables of growing size."""
    inputs = {
        source: with_points(
            table(spark, folder, source).select(key), key, "anti_correlated", spread=100.0
        )
        for source, key in _SWEEP
    }
    return sweep_sizes(inputs, _XS4, ["sfs_range", "representatives"]).drop("seconds")


_CROSS = ["p_size", "p_retailprice"]
_CROSS_NAMES = ", ".join(f"('{name}')" for name in STRATEGIES)


@register(
    "H16_strategy_cross_check",
    f"""
    WITH best AS (SELECT * FROM part p WHERE {not_exists("part", _CROSS)})
    SELECT strategy, n_all, n_distinct, 0::BIGINT AS missing, 0::BIGINT AS surplus
    FROM (VALUES {_CROSS_NAMES}) s(strategy), (SELECT count(*) AS n_all,
      count(DISTINCT (p_size, p_retailprice)) AS n_distinct FROM best)
    """,
)
def cross_check(spark, folder):
    """Sizes with all ties and without, by strategy, and how far each differs from ``sql``."""
    rows = part(spark, folder)
    sizes = reduce(
        DataFrame.unionByName,
        [
            skyline(rows, _CROSS, name).agg(
                F.lit(name).alias("strategy"),
                F.count(F.lit(1)).alias("n_all"),
                F.count_distinct(*_CROSS).alias("n_distinct"),
            )
            for name in STRATEGIES
        ],
    )
    return sizes.join(compare_strategies(rows, _CROSS), "strategy").select(
        "strategy", "n_all", "n_distinct", "missing", "surplus"
    )
