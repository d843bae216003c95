"""Sources, cleaning, predicates, geometry, layout and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogue.registry import dominates, not_exists, register, table
from pareto_frame.functions import dominance, geometry
from pareto_frame.operators import cleaning, partitioning
from pareto_frame.operators.aggregates import (
    best_representatives,
    occupied_cells,
    pack_cells,
)
from pareto_frame.plans.jobs import phase_counts
from pareto_frame.plans.skyline import skyline
from pareto_frame.session import materialise, scratch_path
from pareto_frame.sources import delimited, generate
from pareto_frame.sources.rows import from_rows, named_view

# A. sources


def _written(df, spark, label):
    path = scratch_path(spark, label)
    df.write.option("sep", ";").option("header", True).csv(path)
    return path


@register(
    "A1_sensor_file",
    """
    SELECT DISTINCT l_quantity AS m6, l_extendedprice AS m7, l_discount AS m8, l_tax AS m9
    FROM lineitem
    WHERE NOT (l_returnflag = 'R' AND l_linenumber = 6) AND l_linenumber <> 7
    """,
)
def sensor_file(spark, folder):
    """Lineitem written as a sensor file, with unreadable and empty fields, and loaded."""
    line = table(spark, folder, "lineitem")
    bad_tax = F.when(F.col("l_linenumber") == 7, "?").otherwise(F.col("l_tax").cast("string"))
    empty = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 6)
    discount = F.when(~empty, F.col("l_discount").cast("string"))
    shaped = line.select(
        F.col("l_shipdate").cast("date").cast("string").alias("day"),
        F.lit("00:00:00").alias("time"),
        F.col("l_orderkey").alias("m0"),
        F.col("l_partkey").alias("m1"),
        F.col("l_suppkey").alias("m2"),
        F.col("l_linenumber").alias("m3"),
        F.col("l_returnflag").alias("m4"),
        F.col("l_linestatus").alias("m5"),
        F.col("l_quantity").alias("m6"),
        F.col("l_extendedprice").alias("m7"),
        discount.alias("m8"),
        bad_tax.alias("m9"),
        F.lit(0).alias("last"),
    )
    return delimited.load_sensor_file(spark, _written(shaped, spark, "sensor"), num_col=4)


@register(
    "A1_sensor_file_by_number",
    """
    SELECT DISTINCT l_discount AS m8, CASE WHEN l_linenumber % 3 > 0 THEN l_tax END AS m9
    FROM lineitem WHERE l_linenumber % 3 > 0
    """,
)
def sensor_file_by_number(spark, folder):
    """A file of numbers only, some written with one digit more: copies are found by number."""
    line = table(spark, folder, "lineitem")
    zero = F.when(F.col("l_linenumber") % 2 == 0, "0").otherwise("")
    tax = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.col("l_tax").cast("string"), zero))
    shaped = line.select(
        *[F.lit(i).alias(f"c{i}") for i in range(10)],
        F.concat(F.col("l_discount").cast("string"), zero).alias("m8"),
        tax.alias("m9"),
        F.lit(0).alias("last"),
    )
    return delimited.load_sensor_file(spark, _written(shaped, spark, "sensor"), num_col=2)


@register(
    "A2_power_file",
    """
    SELECT DISTINCT CAST(o_custkey AS DOUBLE) AS a, o_totalprice AS b,
           CAST(o_orderkey AS DOUBLE) AS c, CAST(length(o_orderpriority) AS DOUBLE) AS d
    FROM orders WHERE o_orderstatus <> 'P'
    """,
)
def power_file(spark, folder):
    orders = table(spark, folder, "orders")
    price = F.when(F.col("o_orderstatus") == "P", "?").otherwise(
        F.col("o_totalprice").cast("string")
    )
    shaped = orders.select(
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.lit("00:00:00").alias("time"),
        F.col("o_custkey").alias("a"),
        price.alias("b"),
        F.col("o_orderkey").alias("c"),
        F.length("o_orderpriority").alias("d"),
        F.lit(1).alias("e"),
        F.lit(2).alias("f"),
        F.lit(3).alias("g"),
    )
    return delimited.load_power_file(spark, _written(shaped, spark, "power"), num_col=4)


_GIVEN = [(1, 990.0), (25, 905.0), (49, 900.5)]


@register(
    "A3_rows_in_memory",
    f"""
    WITH given(p_size, p_retailprice) AS (VALUES {", ".join(str(r) for r in _GIVEN)})
    SELECT p_partkey, p_size, p_retailprice FROM part p
    WHERE {not_exists("given", ["p_size", "p_retailprice"])}
    """,
)
def rows_in_memory(spark, folder):
    """Parts that none of three rows held by the caller dominates."""
    from pareto_frame.operators.joins import survivors

    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    given = from_rows(spark, _GIVEN, "p_size int, p_retailprice double")
    return survivors(part, ["p_size", "p_retailprice"], given)


@register(
    "A4_named_view",
    "SELECT p_size, min(p_retailprice) AS low, count(*) AS n FROM part GROUP BY p_size",
)
def view(spark, folder):
    with named_view(table(spark, folder, "part")) as name:
        return spark.sql(
            f"SELECT p_size, min(p_retailprice) AS low, count(*) AS n FROM {name} GROUP BY p_size"
        )


def uniform_sql(row_id: str, j: int, seed: int = 0) -> str:
    p = generate.PRIME
    m, s, one = generate.FIRST_ROUND
    a = f"(({row_id} + {seed}) * {m} + {s * j + one}) % {p}"
    b0, b1 = generate.SECOND_ROUND
    b = f"(({a}) * ({a}) + {b0 + b1 * j}) % {p}"
    c0, c1 = generate.THIRD_ROUND
    return f"((({b}) * ({b}) + {c0 + c1 * j}) % {p}) / {p}.0e0"


def points_sql(source, row_id, kind, dims=4, lo=0.0, hi=1.0, spread=10.0, seed=0) -> str:
    u = [f"({uniform_sql(row_id, j, seed)})" for j in range(dims)]
    draws = ", ".join(f"{x} AS u{j}" for j, x in enumerate(u))
    width = f"{spread * 0.01!r}::DOUBLE"
    x0 = f"(u0 * {hi - lo!r}e0 + {lo!r}e0)"
    others = {
        "independent": lambda j: f"u{j} * {hi - lo!r}e0 + {lo!r}e0",
        "correlated": lambda j: f"{x0} + (u{j} - 0.5e0) * {width}",
        "anti_correlated": lambda j: (
            f"({hi!r}e0 - {x0}) + ({hi!r}e0 - {x0}) * (u{j} - 0.5e0) * {width}"
        ),
    }[kind]
    xs = ", ".join([f"{x0} AS x0", *[f"{others(j)} AS x{j}" for j in range(1, dims)]])
    return f"SELECT {row_id}, {xs} FROM (SELECT {row_id}, {draws} FROM {source})"


def _register_generator(name, source, row_id, kind, **settings):
    @register(name, points_sql(source, row_id, kind, **settings))
    def generated(spark, folder):
        ids = table(spark, folder, source).select(row_id)
        return generate.with_points(ids, row_id, kind, **settings)


_register_generator("A5_independent", "orders", "o_orderkey", "independent")
_register_generator("A6_correlated", "orders", "o_orderkey", "correlated")
_register_generator("A7_anti_correlated", "orders", "o_orderkey", "anti_correlated", spread=100.0)
_register_generator(
    "A8_generator_settings",
    "events",
    "event_id",
    "anti_correlated",
    dims=3,
    lo=10.0,
    hi=20.0,
    spread=50.0,
    seed=7,
)

_TOY_VALUES = ", ".join(str(t) for t in generate.TOY_POINTS)


def _toy_sql() -> str:
    def corner(k: int) -> str:
        whens = " ".join(f"WHEN {i} THEN {t[k]}" for i, t in enumerate(generate.TOY_SKYLINE))
        return f"CASE p_partkey % 5 {whens} END"

    return f"""
        SELECT * FROM (VALUES {_TOY_VALUES}) t(x0, x1)
        UNION ALL
        SELECT {corner(0)} + CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE p_partkey + 1 END,
               {corner(1)} + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey + 1 END
        FROM part
    """


def _toy(spark, folder):
    base = generate.toy_points(spark)
    return base.unionByName(generate.toy_padding(table(spark, folder, "part"), "p_partkey"))


register("A9_toy_points", _toy_sql())(_toy)


@register(
    "A9_toy_skyline",
    f"WITH t AS ({_toy_sql()}) SELECT * FROM t p WHERE {not_exists('t', ['x0', 'x1'])}",
)
def toy_skyline(spark, folder):
    """One dominated point per part leaves the five known points."""
    return skyline(_toy(spark, folder), ["x0", "x1"])


@register(
    "A10_written_result",
    f"SELECT p_partkey, p_size, p_retailprice FROM part p "
    f"WHERE {not_exists('part', ['p_size', 'p_retailprice'])}",
)
def written_result(spark, folder):
    """The result goes to a file and is read back, without passing the caller."""
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    path = scratch_path(spark, "result")
    skyline(part, ["p_size", "p_retailprice"]).write.parquet(path)
    return spark.read.parquet(path)


# B. cleaning and scaling

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("B1_keep_measures", "SELECT l_extendedprice, l_discount, l_tax FROM lineitem")
def measures(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", *MEASURES)
    return cleaning.keep_measures(line, 3, [0, 1, 2, 3, 4, 5], 2, 2, 4)


@register("B2_distinct_rows", "SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem")
def distinct_rows(spark, folder):
    line = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return cleaning.drop_duplicate_rows(line)


_SUFFIXES = ["", "d", "f", "D", "e1", ".5", " ", "x"]
_TEXT = (
    "CASE WHEN p_type = 'ECONOMY' THEN p_name WHEN p_size % 9 = 0 THEN '0x1p3' WHEN p_size % 10 = 0 THEN '' "
    f"ELSE CAST(p_size AS VARCHAR) || ({_SUFFIXES})[p_partkey % {len(_SUFFIXES)} + 1] END"
)


@register(
    "B3_numeric_coercion",
    f"SELECT p_partkey, TRY_CAST({_TEXT} AS DOUBLE) AS size FROM part",
)
def coerced(spark, folder):
    part = table(spark, folder, "part")
    suffix = F.get(F.array(*map(F.lit, _SUFFIXES)), (F.col("p_partkey") % len(_SUFFIXES)).cast("int"))
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.col("p_name"))
        .when(F.col("p_size") % 9 == 0, "0x1p3")
        .when(F.col("p_size") % 10 == 0, "")
        .otherwise(F.concat(F.col("p_size").cast("string"), suffix))
    )
    return cleaning.coerce_numeric(part.select("p_partkey", text.alias("size")), ["size"])


@register(
    "B4_complete_rows",
    f"SELECT p_partkey, TRY_CAST({_TEXT} AS DOUBLE) AS size FROM part "
    f"WHERE TRY_CAST({_TEXT} AS DOUBLE) IS NOT NULL",
)
def complete(spark, folder):
    return cleaning.drop_incomplete(coerced(spark, folder), ["size"])


@register("B5_numeric_dimensions", "SELECT p_partkey, p_size, p_retailprice FROM part")
def default_dims(spark, folder):
    part = table(spark, folder, "part")
    return part.select(*cleaning.numeric_dims(part))


def scaled_sql(source, columns, dims, half_open=False, per_dim=True, cells=False) -> str:
    """CTE body: ``columns`` and every dimension ``d`` scaled, as ``s_d``."""
    lo = {d: f"min({d})" for d in dims}
    hi = {d: f"max({d})" for d in dims}
    if not per_dim:
        lo = dict.fromkeys(dims, f"least({', '.join(lo.values())})")
        hi = dict.fromkeys(dims, f"greatest({', '.join(hi.values())})")
    bounds = ", ".join(f"{lo[d]} AS lo_{d}, {hi[d]} AS hi_{d}" for d in dims)
    factor = "0.999999e0 * " if half_open else ""
    s = ", ".join(f"{factor}({d} - lo_{d}) / (hi_{d} - lo_{d}) AS s_{d}" for d in dims)
    return f"SELECT {', '.join(columns)}, {s} FROM {source}, (SELECT {bounds} FROM {source})"


def _renamed(dims):
    return ", ".join(f"s_{d} AS {d}" for d in dims)


@register(
    "B6_normalise",
    f"SELECT l_orderkey, {_renamed(MEASURES)} "
    f"FROM ({scaled_sql('lineitem', ['l_orderkey'], MEASURES, per_dim=False)})",
)
def normalised(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", *MEASURES)
    return cleaning.normalise(line, MEASURES)


@register(
    "B7_normalise_half_open",
    f"SELECT l_orderkey, {_renamed(MEASURES)} "
    f"FROM ({scaled_sql('lineitem', ['l_orderkey'], MEASURES, True, False)})",
)
def normalised_half_open(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", *MEASURES)
    return cleaning.normalise(line, MEASURES, half_open=True)


@register(
    "B7_normalise_per_dimension",
    f"SELECT l_orderkey, {_renamed(MEASURES)} "
    f"FROM ({scaled_sql('lineitem', ['l_orderkey'], MEASURES, True)})",
)
def normalised_per_dim(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", *MEASURES)
    return cleaning.normalise(line, MEASURES, half_open=True, per_dim=True)


_S = [f"s_{d}" for d in MEASURES]


@register(
    "B8_annulus",
    f"SELECT l_orderkey, {_renamed(MEASURES)} "
    f"FROM ({scaled_sql('lineitem', ['l_orderkey'], MEASURES)}) "
    f"WHERE {' + '.join(f'{s} * {s}' for s in _S)} BETWEEN 0.0625e0 AND 0.25e0",
)
def ring(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", *MEASURES)
    scaled = cleaning.normalise(line, MEASURES, per_dim=True)
    return cleaning.annulus(scaled, MEASURES, inner=0.25, outer=0.5)


@register(
    "B9_subspace",
    """
    WITH low AS (SELECT l_tax, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_tax)
    SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem p
    WHERE NOT EXISTS (SELECT 1 FROM low q WHERE q.l_tax <= p.l_tax
        AND q.l_extendedprice <= p.l_extendedprice
        AND (q.l_tax < p.l_tax OR q.l_extendedprice < p.l_extendedprice))
    """,
)
def subspace(spark, folder):
    """Two of the four measures compete; the others are carried along."""
    line = table(spark, folder, "lineitem").select("l_orderkey", *MEASURES)
    return skyline(line, ["l_extendedprice", "l_tax"])


# C. predicates: the part of a line against the line itself

_PAIR_SQL = """
    SELECT l_returnflag,
           p_size AS q0, CAST(floor((p_retailprice - 900) / 2) AS INT) AS q1,
           CAST(l_quantity AS INT) AS p0, l_linenumber * 7 AS p1
    FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def _pairs(spark, folder):
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        "l_returnflag",
        F.col("p_size").alias("q0"),
        F.floor((F.col("p_retailprice") - 900) / 2).cast("int").alias("q1"),
        F.col("l_quantity").cast("int").alias("p0"),
        (F.col("l_linenumber") * 7).alias("p1"),
    )


def _register_predicate(name, predicate, sql):
    text = f"SELECT l_returnflag, count(*) AS n FROM ({_PAIR_SQL}) WHERE {sql} GROUP BY l_returnflag"

    @register(name, text)
    def counted(spark, folder):
        q, p = [F.col("q0"), F.col("q1")], [F.col("p0"), F.col("p1")]
        holds = _pairs(spark, folder).filter(predicate(q, p))
        return holds.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


_WEAK = "q0 <= p0 AND q1 <= p1"
_NOT_EQUAL = "NOT (q0 = p0 AND q1 = p1)"
_STRICT = dominates(["q0", "q1"], ["p0", "p1"])
_register_predicate("C1_strict_dominance", dominance.strictly_dominates, _STRICT)
_register_predicate("C2_weak_dominance", dominance.weakly_dominates, _WEAK)
_register_predicate(
    "C3_filter_test", dominance.dominates_unless_equal, f"{_WEAK} AND {_NOT_EQUAL}"
)
_register_predicate(
    "C4_cell_total_dominance", dominance.cell_totally_dominates, "q0 < p0 AND q1 < p1"
)
_register_predicate(
    "C5_cell_may_dominate", dominance.cell_may_dominate, f"{_WEAK} AND {_NOT_EQUAL}"
)
_register_predicate(
    "C6_dominance_in_order",
    dominance.dominates_in_order,
    f"{_WEAK} AND (q0 < p0 OR (q0 = p0 AND q1 < p1))",
)


# D. geometry on the scaled measures of lineitem

_XS = ["l_quantity", "l_extendedprice", "l_tax"]
_SCALED = f"({scaled_sql('lineitem', ['l_orderkey', 'l_linenumber'], _XS)})"
_SX = [f"s_{d}" for d in _XS]
_ID = "l_orderkey, l_linenumber"


def _scaled(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *_XS)
    return cleaning.normalise(line, _XS, per_dim=True)


def _register_geometry(name, build, sql):
    @register(name, sql)
    def computed(spark, folder):
        columns = build([F.col(x) for x in _XS])
        return _scaled(spark, folder).select("l_orderkey", "l_linenumber", *columns)


_N2 = " + ".join(f"{s} * {s}" for s in _SX)
_register_geometry(
    "D1_norm",
    lambda xs: [geometry.squared_norm(xs).alias("n2"), geometry.norm(xs).alias("n")],
    f"SELECT {_ID}, {_N2} AS n2, sqrt({_N2}) AS n FROM {_SCALED}",
)
_R1 = f"greatest(0e0, ({_N2}) - {_SX[0]} * {_SX[0]})"
_R2 = f"greatest(0e0, {_R1} - {_SX[1]} * {_SX[1]})"
_T1 = f"sqrt({_R1}) / CASE WHEN {_SX[0]} = 0 THEN 0.0001e0 ELSE {_SX[0]} END"
_T2 = f"sqrt({_R2}) / CASE WHEN {_SX[1]} = 0 THEN 0.0001e0 ELSE {_SX[1]} END"


_register_geometry(
    "D2_angles",
    lambda xs: [F.round(a, 9).alias(f"a{i}") for i, a in enumerate(geometry.angles(xs))],
    f"SELECT {_ID}, round(atan({_T1}), 9) AS a0, round(atan({_T2}), 9) AS a1 FROM {_SCALED}",
)
_register_geometry(
    "D3_angular_bucket",
    lambda xs: [geometry.angular_bucket(xs, 8).alias("bucket")],
    f"""
    SELECT {_ID}, CAST(floor(atan({_T1}) * {geometry.TWO_OVER_PI * 8!r}::DOUBLE) AS BIGINT)
        + 8 * CAST(floor(atan({_T2}) * {geometry.TWO_OVER_PI * 8!r}::DOUBLE) AS BIGINT) AS bucket
    FROM {_SCALED}
    """,
)


def _coordinate_sql(s, n):
    return f"CASE WHEN {s} >= 1 THEN {n - 1} ELSE CAST(floor({s} * {n}) AS BIGINT) END"


_C = [_coordinate_sql(s, 8) for s in _SX]
_register_geometry(
    "D4_grid_coordinates",
    lambda xs: [c.alias(f"c{i}") for i, c in enumerate(geometry.grid_coordinates(xs, 8))],
    f"SELECT {_ID}, {', '.join(f'{c} AS c{i}' for i, c in enumerate(_C))} FROM {_SCALED}",
)
_CELL = " + ".join(f"{8**i} * ({c})" for i, c in enumerate(_C))
_register_geometry(
    "D5_grid_cell",
    lambda xs: [geometry.cell_id(geometry.grid_coordinates(xs, 8), 8).alias("cell")],
    f"SELECT {_ID}, {_CELL} AS cell FROM {_SCALED}",
)


@register(
    "D6_cell_corner",
    f"""
    SELECT cell, {", ".join(f"(cell // {8**j}) % 8 AS c{j}" for j in range(3))},
           {", ".join(f"((cell // {8**j}) % 8 + 1) / 8.0e0 AS u{j}" for j in range(3))}
    FROM (SELECT DISTINCT {_CELL} AS cell FROM {_SCALED})
    """,
)
def corners(spark, folder):
    """Coordinates and upper corner of every occupied cell."""
    xs = [F.col(x) for x in _XS]
    cell = geometry.cell_id(geometry.grid_coordinates(xs, 8), 8).alias("cell")
    cells = occupied_cells(_scaled(spark, folder).select(cell), ["cell"])
    digits = geometry.cell_digits(F.col("cell"), 3, 8)
    upper = geometry.cell_upper_corner(F.col("cell"), 3, 8)
    return cells.select(
        "cell",
        *[c.cast("bigint").alias(f"c{i}") for i, c in enumerate(digits)],
        *[u.alias(f"u{i}") for i, u in enumerate(upper)],
    )


_VOLUME = " * ".join(f"(1 - {s})" for s in _SX)
_register_geometry(
    "D7_dominated_volume",
    lambda xs: [geometry.dominated_volume(xs).alias("volume")],
    f"SELECT {_ID}, {_VOLUME} AS volume FROM {_SCALED}",
)


# E. layout: every query shows a property that rows have only if they are laid out

_LAYOUT_DIMS = ["o_totalprice", "o_custkey"]


def _orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", *_LAYOUT_DIMS)


@register(
    "E1_first_dimension_ranges",
    "SELECT true AS apart, true AS several, true AS sorted, count(*) AS n FROM orders",
)
def ranges(spark, folder):
    """Ranges of the first dimension do not overlap, there are several, and each is sorted."""
    laid = materialise(
        partitioning.by_first_dimension(_orders(spark, folder), _LAYOUT_DIMS, 8)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id())
    ).rows
    by_place = Window.partitionBy("part").orderBy("place")
    dims = F.struct(*_LAYOUT_DIMS)
    parts = (
        laid.withColumn("falls", dims < F.lag(dims).over(by_place))
        .groupBy("part")
        .agg(
            F.min(dims).alias("lo"),
            F.max(dims).alias("hi"),
            F.coalesce(F.max("falls"), F.lit(False)).alias("falls"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    # at most 8 rows
    parts = parts.withColumn("before", F.max("hi").over(Window.orderBy("part").rowsBetween(-8, -1)))
    return parts.agg(
        F.min(F.coalesce(F.col("before") <= F.col("lo"), F.lit(True))).alias("apart"),
        (F.count(F.lit(1)) > 4).alias("several"),
        (~F.max("falls")).alias("sorted"),
        F.sum("n").alias("n"),
    )


@register(
    "E2_lexicographic_order",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_custkey, o_orderkey) AS place FROM orders",
)
def ordered(spark, folder):
    """The place of each row in the order, counted from where the rows lie."""
    dims = [*_LAYOUT_DIMS, "o_orderkey"]
    laid = partitioning.lexicographic(_orders(spark, folder), dims)
    placed = materialise(
        laid.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ).rows
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.withColumn("before", before), "part").select(
        "o_orderkey", (F.col("before") + F.col("at") - F.col("first") + 1).alias("place")
    )


@register("E3_balanced", "SELECT true AS balanced, true AS together, count(*) AS n FROM orders")
def balanced(spark, folder):
    """Eight partitions of about equal size, copies of a tuple in one of them."""
    rows = _orders(spark, folder).select(*_LAYOUT_DIMS)
    twice = rows.unionByName(rows)
    laid = materialise(partitioning.spread(twice, _LAYOUT_DIMS, 8).withColumn("part", F.spark_partition_id())).rows
    sizes = laid.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    places = laid.groupBy(*_LAYOUT_DIMS).agg(F.count_distinct("part").alias("n"))
    even = sizes.agg(
        ((F.max("n") < 1.5 * F.min("n")) & (F.count(F.lit(1)) == 8)).alias("balanced"),
        F.lit(None).cast("boolean").alias("together"),
        (F.sum("n") / 2).cast("bigint").alias("n"),
    )
    once = places.agg(
        F.lit(None).cast("boolean").alias("balanced"),
        (F.max("n") == 1).alias("together"),
        F.lit(None).cast("bigint").alias("n"),
    )
    columns = ["balanced", "together", "n"]
    return even.unionByName(once).agg(*[F.max(c).alias(c) for c in columns])


@register(
    "E4_key_partitions",
    f"SELECT cell, count(*) AS n, true AS neighbours FROM (SELECT {_CELL} AS cell FROM {_SCALED}) GROUP BY cell",
)
def keyed(spark, folder):
    """Rows per cell, and that a cell lies in neighbouring partitions, after all smaller cells."""
    xs = [F.col(x) for x in _XS]
    cell = geometry.cell_id(geometry.grid_coordinates(xs, 8), 8)
    placed = _scaled(spark, folder).withColumn("cell", cell)
    laid = materialise(
        partitioning.by_key(placed, F.col("cell"), _XS, 8).select("cell").withColumn("part", F.spark_partition_id())
    ).rows
    cells = laid.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("part").alias("first"), F.max("part").alias("last")
    )
    # at most 8 ** 3 rows
    smaller = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.max("last").over(smaller) <= F.col("first"), F.lit(True))
    return cells.select("cell", "n", after.alias("neighbours"))


# F. aggregates


@register(
    "F1_extent",
    "SELECT least(min(l_quantity), min(l_extendedprice), min(l_tax)) AS lo, "
    "greatest(max(l_quantity), max(l_extendedprice), max(l_tax)) AS hi FROM lineitem",
)
def whole_extent(spark, folder):
    return cleaning.extent(table(spark, folder, "lineitem"), _XS)


def representatives_sql(source, dims, n, columns=()) -> str:
    """Per dimension and slice the row with the largest dominated volume."""
    s = [f"s_{d}" for d in dims]
    volume = " * ".join(f"(1 - {x})" for x in s)
    names = ", ".join(dims)
    slots = " UNION ALL ".join(
        f"SELECT {i} AS dim, CAST(least(floor({x} * {n}), {n - 1}) AS INT) AS bucket, "
        f"{volume} AS volume, {names} FROM scaled"
        for i, x in enumerate(s)
    )
    return f"""
        WITH scaled AS ({scaled_sql(source, list(dims), dims)}),
        slots AS ({slots}),
        ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY dim, bucket ORDER BY volume DESC, {names}) AS place
            FROM slots WHERE volume > 0)
        SELECT dim, bucket, {names} FROM ranked WHERE place = 1
    """


@register("F2_representatives", representatives_sql("lineitem", MEASURES, 10))
def representatives(spark, folder):
    line = table(spark, folder, "lineitem").select(*MEASURES)
    scaled_names = {f"s_{d}": F.col(d) for d in MEASURES}
    scaled = cleaning.normalise(line.withColumns(scaled_names), list(scaled_names), per_dim=True)
    return best_representatives(scaled, MEASURES, [F.col(s) for s in scaled_names], 10)


@register(
    "F3_packed_cells",
    f"""
    SELECT cell, count(*) AS n_rows, count(DISTINCT ({", ".join(_XS)})) AS n_tuples
    FROM (SELECT {", ".join(_XS)}, {_CELL} AS cell
          FROM ({scaled_sql("lineitem", _XS, _XS)}))
    GROUP BY cell
    """,
)
def packed(spark, folder):
    """Rows packed per cell, then unpacked into sizes."""
    xs = [F.col(x) for x in _XS]
    cell = geometry.cell_id(geometry.grid_coordinates(xs, 8), 8)
    placed = _scaled(spark, folder).withColumn("cell", cell)
    chunks = pack_cells(placed, "cell", _XS)
    points = chunks.select("cell", F.inline("points"))
    return points.groupBy("cell").agg(
        F.sum("copies").alias("n_rows"), F.count(F.lit(1)).alias("n_tuples")
    )


@register(
    "F4_occupied_cells",
    f"SELECT DISTINCT {', '.join(f'{c} AS c{i}' for i, c in enumerate(_C))} FROM {_SCALED}",
)
def occupied(spark, folder):
    xs = [F.col(x) for x in _XS]
    coordinates = [c.alias(f"c{i}") for i, c in enumerate(geometry.grid_coordinates(xs, 8))]
    return occupied_cells(_scaled(spark, folder).select(*coordinates), ["c0", "c1", "c2"])


_FX = ["o_totalprice", "o_custkey", "o_day"]
_F_ROWS = (
    "(SELECT o_totalprice, -o_custkey AS o_custkey, "
    "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS o_day FROM orders)"
)
_FC = " + ".join(f"{4**i} * ({_coordinate_sql(f's_{d}', 4)})" for i, d in enumerate(_FX))


@register(
    "F5_phase_counts",
    f"""
    WITH o AS {_F_ROWS},
    reps AS ({representatives_sql("o", _FX, 10)}),
    kept AS (
        SELECT {", ".join(_FX)}, {_FC} AS cell FROM ({scaled_sql("o", _FX, _FX)}) p
        WHERE {not_exists("reps", _FX)})
    SELECT (SELECT count(*) FROM o) AS n_rows,
           (SELECT count(*) FROM kept) AS n_filtered,
           (SELECT count(*) FROM (SELECT DISTINCT {", ".join(_FX)}, cell FROM kept) p
            WHERE NOT EXISTS (SELECT 1 FROM kept q WHERE q.cell = p.cell AND
                {dominates([f"q.{d}" for d in _FX], [f"p.{d}" for d in _FX])})) AS n_local,
           (SELECT count(*) FROM (SELECT DISTINCT {", ".join(_FX)} FROM kept) p
            WHERE {not_exists("kept", _FX)}) AS n_skyline
    """,
)
def counts(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_totalprice",
        (-F.col("o_custkey")).alias("o_custkey"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("o_day"),
    )
    return phase_counts(orders, _FX)
