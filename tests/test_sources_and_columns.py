import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pareto_frame import skyline
from pareto_frame.functions import geometry
from pareto_frame.operators import cleaning
from pareto_frame.sources import delimited, generate
from pareto_frame.sources.rows import from_rows, named_view
from tests import brute


def write(tmp_path, columns, lines):
    path = tmp_path / "file.csv"
    header = ";".join(f"c{i}" for i in range(columns))
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def sensor_line(*measures):
    filled = ["day", "time", *map(str, range(2, 8)), *measures, "end"]
    return ";".join(filled)


def test_sensor_file(spark, tmp_path):
    path = write(
        tmp_path,
        13,
        [
            sensor_line("1.5", "2", "3", "4"),
            sensor_line("1.5", "2", "3", "4"),
            sensor_line("1.50", "2", "3", "4"),
            sensor_line("?", "2", "3", "4"),
            sensor_line("1", "", "3", "4"),
            sensor_line("0.5", "9", "3", "4"),
        ],
    )
    df = delimited.load_sensor_file(spark, path)
    assert df.columns == ["c8", "c9", "c10", "c11"]
    assert {f.dataType for f in df.schema} == {T.DoubleType()}
    # equal numbers written differently stay two rows
    assert brute.rows(df) == [(0.5, 9, 3, 4), (1.5, 2, 3, 4), (1.5, 2, 3, 4)]
    assert delimited.load_sensor_file(spark, path, 2).columns == ["c10", "c11"]
    assert delimited.load_sensor_file(spark, path, 1).columns == ["c10", "c11"]
    assert delimited.load_sensor_file(spark, path, 99).columns == [f"c{i}" for i in range(2, 12)]
    assert brute.rows(skyline(df)) == [(0.5, 9, 3, 4), (1.5, 2, 3, 4), (1.5, 2, 3, 4)]


def test_power_file(spark, tmp_path):
    path = write(tmp_path, 9, ["d;t;1;2;3;4;5;6;7", "d;u;1;2;3;4;5;6;7", "d;t;1;?;3;4;5;6;7"])
    kept = {2: [3, 5], 4: [2, 3, 4, 5], 7: [2, 3, 4, 5, 6, 7, 8]}
    for wanted, positions in kept.items():
        df = delimited.load_power_file(spark, path, wanted)
        assert df.columns == [f"c{i}" for i in positions]
    assert brute.rows(delimited.load_power_file(spark, path)) == [(1, 2, 3, 4)]


def test_rows_keep_their_types(spark):
    df = from_rows(spark, [(1, 0.1, "a"), (2, 0.30000000000000004, "b")])
    assert [f.dataType for f in df.schema] == [T.LongType(), T.DoubleType(), T.StringType()]
    assert cleaning.numeric_dims(df) == ["x0", "x1"]
    assert df.collect()[1].x1 == 0.30000000000000004


def test_view_is_dropped(spark):
    with named_view(spark.range(3)) as name:
        found = spark.sql(f"SELECT count(*) AS n FROM {name}")
        assert spark.catalog.tableExists(name)
    assert not spark.catalog.tableExists(name)
    assert found.first().n == 3


def test_points_do_not_depend_on_partitions(spark):
    settings = {"kind": "anti_correlated", "dims": 3, "spread": 100.0, "seed": 5}
    a = generate.with_points(spark.range(0, 500, 1, 1), "id", **settings)
    b = generate.with_points(spark.range(0, 500, 1, 7), "id", **settings)
    assert brute.rows(a) == brute.rows(b)
    c = generate.with_points(spark.range(500), "id", **{**settings, "seed": 6})
    assert brute.rows(c) != brute.rows(a)


def test_points_follow_their_kind(spark):
    for kind, sign in (("correlated", 1), ("anti_correlated", -1)):
        df = generate.generate_points(spark, 2000, kind, dims=2)
        assert sign * df.stat.corr("x0", "x1") > 0.9
    df = generate.generate_points(spark, 2000, lo=10.0, hi=20.0, dims=2)
    assert abs(df.stat.corr("x0", "x1")) < 0.1
    low, high = df.agg(F.min("x1"), F.max("x1")).first()
    assert 10 <= low < 11 and 19 < high < 20
    with pytest.raises(ValueError):
        generate.generate_points(spark, 1, "round")


def test_scaling(spark):
    df = spark.createDataFrame([(0.0, 7.0), (5.0, 7.0), (10.0, 7.0)], "a double, b double")
    whole = brute.rows(cleaning.normalise(df, ["a", "b"]))
    assert whole == [(0.0, 0.7), (0.5, 0.7), (1.0, 0.7)]
    half = brute.rows(cleaning.normalise(df, ["a", "b"], half_open=True, per_dim=True))
    assert [r[0] for r in half] == pytest.approx([0.0, 0.4999995, 0.999999])
    assert [r[1] for r in half] == [0.0, 0.0, 0.0]
    odd = spark.createDataFrame([(0.0,), (2.0,), (math.inf,), (math.nan,)], "a double")
    low, high = cleaning.extent(odd, ["a"]).first()
    assert (low, high) == (0.0, 2.0)


def test_annulus_includes_both_ends(spark):
    df = spark.createDataFrame([(0.3, 0.4), (0.6, 0.8), (0.0, 0.1)], "a double, b double")
    assert brute.rows(cleaning.annulus(df, ["a", "b"], 0.5, 1.0)) == [(0.3, 0.4), (0.6, 0.8)]


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.5, 0.5), (0.5, 0.5, 0.0)], "a double, b double, c double")
    xs = [F.col(c) for c in df.columns]
    tangents = df.select(*geometry.angle_ratios(xs)).collect()
    assert tangents[0][0] == pytest.approx(math.sqrt(0.5) / 0.0001)
    assert tangents[1] == pytest.approx((1.0, 0.0))
    grid = df.select(*geometry.grid_coordinates(xs, 4), F.lit(1.0)).first()
    assert tuple(grid)[:3] == (0, 2, 2)
    cell = geometry.cell_id([F.lit(1), F.lit(2), F.lit(3)], 4)
    digits = geometry.cell_digits(cell, 3, 4)
    corner = geometry.cell_upper_corner(cell, 3, 4)
    assert tuple(df.select(*digits).first()) == (1, 2, 3)
    assert tuple(df.select(*corner).first()) == (0.5, 0.75, 1.0)
    assert df.select(geometry.grid_coordinate(F.lit(1.0), 4)).first()[0] == 3
