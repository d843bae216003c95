"""Frequent tuples are found, spread evenly, and lose no row."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pareto_frame import skyline
from pareto_frame.operators import aggregates, joins
from pareto_frame.operators.frequent import SALT, frequent, repeated, salted
from pareto_frame.session import materialise


@pytest.fixture(scope="module")
def rows(spark):
    hot = F.col("id") % 10 < 9
    return spark.range(20_000).select(
        "id",
        F.when(hot, F.lit(-0.0)).otherwise((F.col("id") % 1777).cast("double")).alias("x"),
        F.when(hot, F.lit(None).cast("int")).otherwise((F.col("id") % 991).cast("int")).alias("k"),
    )


def test_ninety_per_cent_in_one_tuple(spark, rows):
    exprs = [F.col("x"), F.col("k")]
    hot = materialise(frequent(rows, exprs, 8)).rows
    found = hot.collect()
    # 18 000 of 20 000 rows, an even share being 2 500, in parts of a quarter of it
    assert len(found) == 1 and found[0].salts == 29
    spread = salted(rows, exprs, hot)
    assert spread.count() == 20_000 and spread.select(SALT).distinct().count() == 29
    sizes = spread.groupBy("x", "k", SALT).count().orderBy(F.desc("count")).limit(29).collect()
    assert sizes[0]["count"] <= 1.1 * 18_000 / 29
    tasks = spread.repartition(8, *exprs, SALT).groupBy(F.spark_partition_id()).count().collect()
    counts = sorted(r["count"] for r in tasks)
    assert counts[-1] <= 2 * counts[len(counts) // 2]
    assert repeated(rows.select("x", "k").distinct(), ["x", "k"], hot).filter("k is null").count() == 29


def test_no_frequent_tuple_and_no_rows(spark, rows):
    assert frequent(rows, [F.col("id")], 8).count() == 0
    assert frequent(rows.limit(0), [F.col("id")], 8).count() == 0


def test_rows_come_back_whole(spark, rows, monkeypatch):
    """Zeros of both signs and nulls meet their tuple in the shuffled form too."""
    monkeypatch.setattr(joins, "SEMI_BROADCAST_VALUES", 2)
    tuples = spark.createDataFrame([(0.0, None), (5.0, 5), (1e9, 1)], "a double, b int")
    found = joins.matching_rows(rows, [F.col("x"), F.col("k")], tuples, ["a", "b"], None)
    assert found.columns == ["id", "x", "k"]
    expected = rows.filter("k is null or (x = 5 and k = 5)")
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, expected.collect()))
    full = rows.fillna({"k": 3})
    found = Counter(map(tuple, skyline(full, ["x", "k"]).collect()))
    monkeypatch.undo()
    assert found == Counter(map(tuple, skyline(full, ["x", "k"], "sql").collect()))


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_packed_cells_with_a_hot_cell(spark, monkeypatch, bound):
    """Sizes shipped or joined by shuffle: the same chunks of bounded size, with every tuple and copy."""
    monkeypatch.setattr(aggregates, "SEMI_BROADCAST_VALUES", bound)
    cell = F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id") % 50)
    df = spark.range(6000).select(cell.cast("int").alias("cell"), (F.col("id") % 3000).alias("a"), (F.col("id") * 7 % 3000).alias("b"))
    packed = aggregates.pack_cells(df, "cell", ["a", "b"], chunk_rows=100)
    rows = packed.select("cell", F.inline("points"))
    expected = df.groupBy("cell", "a", "b").agg(F.count(F.lit(1)).alias("copies"))
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, expected.collect()))
    assert packed.select(F.max(F.size("points"))).first()[0] < 200
    chunks = {(r.cell, r.chunk) for r in packed.collect()}
    assert len(chunks) == packed.count() and len([c for c in chunks if c[0] == 1]) >= 20


@pytest.mark.parametrize("limit", [0, 100_000])
def test_cells_by_the_packed_tree(spark, limit):
    cells = spark.range(3000).select(*[(F.xxhash64("id", F.lit(i)) % 9 + 8).cast("int").alias(f"c{i}") for i in range(3)]).distinct()
    names = ["c0", "c1", "c2"]
    points = [tuple(r) for r in cells.collect()]
    expected = {p for p in points if not any(all(a < b for a, b in zip(q, p)) for q in points)}
    found = joins.surviving_cells(cells, names, limit)
    assert {tuple(r) for r in found.collect()} == expected
