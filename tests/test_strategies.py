"""Every strategy returns the same rows as the definition."""

import math

import pytest
from pyspark.sql import functions as F

from pareto_frame import STRATEGIES, compare_strategies, skyline
from pareto_frame.operators import joins, merge
from pareto_frame.plans import skyline as plans
from pareto_frame.sources.generate import KINDS, TOY_SKYLINE, generate_points, toy_points
from tests import brute

ALL = sorted(STRATEGIES)


def in_memory(df):
    """Short plans: the generator is not computed again in every phase."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.mark.parametrize("strategy", ALL)
def test_toy_set(spark, strategy):
    assert brute.rows(skyline(toy_points(spark, 400), strategy=strategy)) == sorted(TOY_SKYLINE)


@pytest.mark.parametrize(
    ("kind", "dims", "spread", "size"),
    [
        ("independent", 2, 10.0, 12),
        ("independent", 3, 10.0, 41),
        ("independent", 4, 10.0, 123),
        ("anti_correlated", 4, 100.0, 834),
        ("correlated", 4, 10.0, 27),
    ],
)
def test_known_sizes(spark, kind, dims, spread, size):
    points = generate_points(spark, 5000, kind, dims=dims, spread=spread)
    names = [f"x{i}" for i in range(dims)]
    assert skyline(points, names).count() == size
    assert skyline(points, names, "sql").count() == size


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("dims", [3])
def test_all_strategies_agree(spark, kind, dims):
    rounded = [F.round(f"x{i}", 2).alias(f"x{i}") for i in range(dims)]
    points = generate_points(spark, 400, kind, dims=dims, spread=100.0).select("id", *rounded)
    points = in_memory(points)
    names = [f"x{i}" for i in range(dims)]
    expected = brute.skyline(tuple(r) for r in points.select(*names).collect())
    assert brute.rows(skyline(points, names, "sql").select(*names)) == expected
    for line in compare_strategies(points, names).collect():
        assert (line.missing, line.surplus) == (0, 0), line.strategy


@pytest.mark.parametrize("dims", [1, 4, 9])
@pytest.mark.parametrize("strategy", ["sfs_range", "angular", "grid_parallel", "grid_filter"])
def test_dimensions(spark, dims, strategy):
    points = in_memory(generate_points(spark, 200, "independent", dims=dims).drop("id"))
    expected = brute.skyline(tuple(r) for r in points.collect())
    assert brute.rows(skyline(points, strategy=strategy)) == expected


def test_very_many_dimensions(spark):
    points = in_memory(generate_points(spark, 60, dims=20).drop("id"))
    points = points.unionByName(points.select(*[(F.col(c) + 1).alias(c) for c in points.columns]))
    expected = brute.skyline(tuple(r) for r in points.collect())
    assert len(expected) == 60
    strategies = ["angular", "grid", "grid_parallel", "grid_filter", "radius_angular"]
    for strategy in [*strategies, "representatives"]:
        assert brute.rows(skyline(points, strategy=strategy)) == expected, strategy


EDGES = {
    "empty": ([], []),
    "all equal": ([(1, 1)] * 5, [(1, 1)] * 5),
    "constant first dimension": ([(1, i) for i in range(40)], [(1, 0)]),
    "fewer rows than partitions": ([(2, 1), (1, 2)], [(1, 2), (2, 1)]),
}


@pytest.mark.parametrize("strategy", ALL)
def test_small_edges(spark, strategy):
    for name, (points, expected) in EDGES.items():
        df = spark.createDataFrame(points, "a int, b int").repartition(8)
        assert brute.rows(skyline(df, ["a", "b"], strategy)) == expected, name


def test_copies_collapse(spark):
    df = spark.createDataFrame([(1, 1)] * 5 + [(0, 2), (0, 3)], "a int, b int")
    for strategy in ("auto", "sql", "sfs", "grid_parallel", "aggregate"):
        found = skyline(df, ["a", "b"], strategy, ties="distinct")
        assert brute.rows(found) == [(0, 2), (1, 1)]


def wide(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"d{i} double" for i in range(len(rows[0]))))


def test_grid_corner_keeps_all(spark):
    rows = [(0.1, 0.95), (0.95, 0.1), (0.6, 0.6)]
    for strategy in ("grid", "grid_parallel", "grid_filter"):
        found = skyline(wide(spark, rows), strategy=strategy, slices=2)
        assert brute.rows(found) == sorted(rows)


def test_far_ring_and_empty_ball(spark):
    rows = [(1.0, 1.0, 1.0, 1.0, 0.1), (0.0, 0.0, 0.0, 0.0, 1.0)]
    assert brute.rows(skyline(wide(spark, rows), strategy="radius_angular")) == sorted(rows)
    rows = [(0.9, 1.0), (1.0, 0.9), (1.0, 1.0)]
    found = skyline(wide(spark, rows), strategy="radius_angular", radius=0.0)
    assert brute.rows(found) == [(0.9, 1.0), (1.0, 0.9)]


@pytest.mark.parametrize("zeros", [6, 8])
def test_no_cap_on_dimensions(spark, zeros):
    rows = [(0.0,) * zeros + (1.0,), (1.0,) * zeros + (0.0,)]
    for strategy in ("bnl", "sfs", "angular", "radius_angular", "representatives"):
        assert brute.rows(skyline(wide(spark, rows), strategy=strategy)) == sorted(rows)


def test_representatives_without_volume(spark):
    rows = [(5.0, 9.0), (9.0, 5.0), (9.0, 9.0)]
    found = skyline(wide(spark, rows), strategy="representatives")
    assert brute.rows(found) == [(5.0, 9.0), (9.0, 5.0)]


def test_given_representatives(spark):
    rows = [(5.0, 9.0), (9.0, 5.0), (9.0, 9.0), (2.0, 9.5)]
    given = spark.createDataFrame([(5.0, 8.0)], "d0 double, d1 double")
    found = skyline(wide(spark, rows), strategy="representatives", given=given)
    # rows that a supplied point dominates go, as with points of the data
    assert brute.rows(found) == [(2.0, 9.5), (9.0, 5.0)]
    for ties in ("all", "distinct"):
        many = skyline(
            wide(spark, rows), strategy="representatives", given=given, broadcast_rows=0, ties=ties
        )
        assert brute.rows(many) == [(2.0, 9.5), (9.0, 5.0)]


def test_nulls(spark):
    rows = [(1, 1), (2, None), (None, None), (3, 3), (1, 1)]
    df = spark.createDataFrame(rows, "a int, b int")
    for strategy in ("auto", "sql", "sfs_range"):
        assert brute.rows(skyline(df, ["a", "b"], strategy)) == [(1, 1), (1, 1)]
        kept = skyline(df, ["a", "b"], strategy, nulls="keep").collect()
        assert sorted(map(str, map(tuple, kept))) == sorted(
            map(str, [(1, 1), (1, 1), (2, None), (None, None)])
        )


@pytest.mark.parametrize("strategy", ALL)
def test_nan_and_infinity(spark, strategy):
    nan, inf = math.nan, math.inf
    rows = [(1.0, 1.0), (nan, 0.5), (3.0, 3.0), (nan, 0.7), (-inf, 9.0), (inf, 0.5), (-inf, inf)]
    found = skyline(wide(spark, rows), strategy=strategy)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(
        map(str, [(1.0, 1.0), (-inf, 9.0), (inf, 0.5)])
    )


def test_doubles_stay_double(spark):
    rows = [(0.1, 0.100000001), (0.1, 0.1)]
    assert brute.rows(skyline(wide(spark, rows))) == [(0.1, 0.1)]


def test_other_types(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('a', date'2020-01-02', 1.50BD), ('b', date'2020-01-01', 2.50BD), "
        "('b', date'2020-01-03', 1.50BD) t(s, d, m)"
    )
    assert [r.s for r in skyline(df, ["d", "m"]).orderBy("s").collect()] == ["a", "b"]
    assert skyline(df, ["s", "d"], "sfs_range").count() == 2
    wide_decimal = df.withColumn("m", F.col("m").cast("decimal(30, 2)"))
    assert skyline(wide_decimal, ["d", "m"], "angular").count() == 2


def test_payload_and_ties(spark):
    df = spark.createDataFrame(
        [(1, 1, "x"), (1, 1, "y"), (2, 0, "z"), (3, 3, "w")], "a int, b int, name string"
    )
    assert brute.rows(skyline(df, ["a", "b"])) == [(1, 1, "x"), (1, 1, "y"), (2, 0, "z")]
    one = skyline(df, ["a", "b"], ties="distinct", tie_break=["name"])
    assert brute.rows(one) == [(1, 1, "x"), (2, 0, "z")]


@pytest.mark.parametrize("dims", [2, 3])
def test_merges_beyond_the_broadcast_bound(spark, monkeypatch, dims):
    monkeypatch.setattr(merge, "BLOCK_ROWS", 60)
    monkeypatch.setattr(plans, "FEW_ROWS", 10)
    points = generate_points(spark, 600, "anti_correlated", dims=dims, spread=100.0).drop("id")
    points = in_memory(points)
    expected = brute.skyline(tuple(r) for r in points.collect())
    for strategy in ("auto", "sql", "grid_parallel", "representatives"):
        found = skyline(points, strategy=strategy, broadcast_rows=3)
        assert brute.rows(found) == expected, strategy


def test_rows_return_through_salted_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "SEMI_BROADCAST_VALUES", 0)
    # one tuple holds most of the rows
    df = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 50 + 1).alias("a"),
        F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 7 + 1).alias("b"),
    )
    found = skyline(df, ["a", "b"])
    assert found.columns == df.columns
    assert found.count() == df.filter("a = 1 and b = 1").count() >= 2000


def test_bad_arguments(spark):
    df = spark.createDataFrame([("x",)], "s string")
    with pytest.raises(ValueError):
        skyline(df)
    with pytest.raises(ValueError):
        skyline(df, ["s"], "fastest")
    with pytest.raises(ValueError):
        skyline(df, ["s"], ties="some")
