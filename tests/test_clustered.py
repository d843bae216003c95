"""Clustered tables: the same rows as a scan of everything, from fewer files."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pareto_frame import skyline
from pareto_frame.sources.clustered import Clustered, write_clustered
from pareto_frame.sources.generate import generate_points
from tests.test_boxes import anti


def counted(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


def files_read(df):
    """Files of the scans of a query that has been run."""
    df.count()
    return len(set(df.inputFiles()))


@pytest.mark.parametrize("kind, most", [("correlated", 0.2), ("independent", 0.8), ("anti_correlated", 1.0)])
def test_dominated_files_are_not_read(spark, tmp_path, kind, most):
    rows = generate_points(spark, 8000, kind, dims=3, spread=100.0 if kind == "anti_correlated" else 10.0)
    dims = ["x0", -F.col("x1"), "x2"] if kind == "independent" else ["x0", "x1", "x2"]
    stored = write_clustered(rows, dims, str(tmp_path / "t"), file_rows=200)
    zones = stored.zones
    assert zones.agg(F.sum("n_rows")).first()[0] == 8000 and 30 <= zones.count() <= 60
    left = stored.files_left()
    assert files_read(stored.rows(left)) == left.count() <= most * zones.count()
    assert counted(stored.skyline(dims)) == counted(skyline(rows, dims))
    assert files_read(stored.skyline(dims, "sql")) <= left.count()


@pytest.mark.parametrize("bound", [0, 100_000])
def test_nulls_copies_nan_and_payload(spark, tmp_path, bound):
    points = [tuple(map(float, p)) for p in anti(np.random.default_rng(4), 300, 2)]
    rows = [(i, *p) for i, p in enumerate(points * 2)] + [(-i, 0.9, 0.9) for i in range(1, 200)]
    rows += [(1000, None, 0.0), (1001, None, None), (1002, float("nan"), 0.0), (1003, 5.0, float("inf"))]
    df = spark.createDataFrame(rows, "id long, `a.x` double, b double")
    stored = write_clustered(df, ["a.x", "b"], str(tmp_path / "t"), file_rows=40)
    assert stored.incomplete().count() == 2
    for nulls in ("drop", "keep"):
        found = stored.skyline(["a.x", "b"], nulls=nulls, broadcast_rows=bound)
        assert counted(found) == counted(skyline(df, ["a.x", "b"], nulls=nulls))
    again = Clustered(spark, str(tmp_path / "t"))
    assert again.zones.groupBy().max("n_rows").first()[0] < 150
    with pytest.raises(ValueError, match="clustered"):
        again.skyline(["b"])


def test_many_files_share_tasks(spark, tmp_path):
    """The tasks that write follow the rows, however small the files are."""
    rows = generate_points(spark, 6000, "independent", dims=3)
    dims = ["x0", "x1", "x2"]
    stored = write_clustered(rows, dims, str(tmp_path / "t"), file_rows=50)
    zones = stored.zones
    assert 120 <= zones.count() <= 124 and zones.agg(F.max("n_rows")).first()[0] == 50
    writers = zones.select(F.regexp_extract("__sky_file", r"part-(\d+)-", 1)).distinct().count()
    assert writers == 4
    assert counted(stored.rows()) == counted(rows)
    assert counted(stored.skyline(dims)) == counted(skyline(rows, dims))


def test_empty_and_text(spark, tmp_path):
    df = spark.createDataFrame([], "a double, b double")
    stored = write_clustered(df, ["a", "b"], str(tmp_path / "t"))
    assert stored.skyline(["a", "b"]).collect() == []
    with pytest.raises(ValueError, match="numbers"):
        write_clustered(df.withColumn("b", F.lit("x")), ["a", "b"], str(tmp_path / "u"))
