"""The merge by super-boxes and the lattice minima, against brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pareto_frame import seeded_skyline, skyline
from pareto_frame.operators import boxes, lattice, partitioning
from pareto_frame.session import materialise
from tests.brute import skyline as brute
from tests.test_plans import plan_of

NAN, INF = float("nan"), float("inf")


def anti(rng, n, d):
    x = rng.random((n, d))
    return (x / x.sum(1, keepdims=True) + 0.02 * rng.random((n, d))).round(3)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("d", [1, 2, 3, 6, 9])
def test_many_boxes(spark, d):
    points = sorted({tuple(map(float, p)) for p in anti(np.random.default_rng(d), 700, d)})
    dims = [f"d{i}" for i in range(d)]
    phase = materialise(spark.createDataFrame(points, dims).repartition(5))
    assert tuples(boxes.box_merge(phase, dims, box_rows=40)) == brute(points)


def test_no_join_of_boxes_and_one_key_per_row(spark):
    points = [tuple(map(float, p)) for p in anti(np.random.default_rng(1), 500, 3)]
    phase = materialise(spark.createDataFrame(points, ["a", "b", "c"]).distinct())
    plan = plan_of(boxes.box_merge(phase, ["a", "b", "c"], box_rows=50))
    assert "NestedLoop" not in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange") and "MapInArrow" in plan


@pytest.mark.parametrize("hot", [0.3, 0.9])
def test_keys_with_nulls_and_a_hot_group(spark, hot):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(900) < hot, "hot", rng.choice(["a", "b", "c"], 900))
    rows = {(None if k == "c" else str(k), *map(float, p)) for k, p in zip(keys, anti(rng, 900, 3))}
    df = spark.createDataFrame(sorted(rows, key=str), "k string, x double, y double, z double")
    expected = Counter()
    for key, group in itertools.groupby(sorted(rows, key=lambda r: str(r[0])), key=lambda r: r[0]):
        expected.update((key, *p) for p in brute([r[1:] for r in group]))
    for size in (30, 2000):
        found = boxes.box_merge(materialise(df), ["x", "y", "z"], ["k"], box_rows=size)
        assert Counter(tuple(r) for r in found.collect()) == expected


def test_types_nan_infinities_and_equal_buckets(spark):
    rows = spark.range(400).select(
        (F.col("id") * 37 % 101).cast("decimal(9,2)").alias("m"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 53 % 97).cast("int")).alias("day"),
        F.when(F.col("id") % 50 == 0, F.lit(NAN)).when(F.col("id") % 50 == 1, F.lit(-INF)).otherwise(
            (F.col("id") * 71 % 89).cast("double")
        ).alias("x"),
        F.lit(1).alias("one"),
    )
    dims = ["m", "day", "x", "one"]
    expected = sorted(map(str, skyline(rows, dims, "sql", ties="distinct").collect()))
    found = boxes.box_merge(materialise(rows.distinct()), dims, box_rows=25)
    assert sorted(map(str, found.collect())) == expected


def test_the_order_lists_dominators_first(spark):
    points = [tuple(map(float, p)) for p in anti(np.random.default_rng(5), 300, 4)]
    df = materialise(spark.createDataFrame(points, ["a", "b", "c", "d"])).rows
    placed = boxes.z_order(df, df.columns)(df).withColumnRenamed(boxes.ORDER, "z").collect()
    assert len({r.z for r in placed}) > 50
    for p, q in itertools.combinations(placed, 2):
        for low, high in ((p, q), (q, p)):
            if all(a <= b for a, b in zip(low[:4], high[:4])):
                assert low.z <= high.z


@pytest.mark.parametrize("strict", [False, True])
def test_covered_in_order(monkeypatch, strict):
    monkeypatch.setattr(boxes, "PANEL", 32)
    monkeypatch.setattr(boxes, "LEAF", 8)
    monkeypatch.setattr(boxes, "FAN", 3)
    rng = np.random.default_rng(7)
    p, q = rng.integers(0, 30, (4, 333)), rng.integers(10, 30, (4, 217))
    q = np.concatenate([q, p[:, :50]], axis=1)
    expected = (q[:, None, :] <= p[:, :, None]).all(0)
    if strict:
        expected &= (q[:, None, :] != p[:, :, None]).any(0)
    tree = boxes.PackedBoxes(q)
    assert len(tree.levels) == 4
    assert (boxes.covered_in_order(p, tree, strict) == expected.any(1)).all()
    assert not boxes.covered_in_order(p, boxes.PackedBoxes(q[:, :0]), strict).any()
    assert boxes.covered_in_order(p[:, :0], tree, strict).shape == (0,)


def test_leaves_are_those_that_reach(monkeypatch):
    monkeypatch.setattr(boxes, "LEAF", 4)
    monkeypatch.setattr(boxes, "FAN", 3)
    points = np.sort(np.random.default_rng(2).integers(0, 99, (3, 301)), axis=1)
    tree = boxes.PackedBoxes(points)
    for upper in ([50, 50, 50], [0, 99, 99], [99, 99, 99], [-1, 5, 5]):
        expected = [i for i in range(76) if (tree.leaf(i).min(1) <= upper).all()]
        assert tree.reaching(np.array(upper)).tolist() == expected


@pytest.mark.parametrize("share", [boxes.SHARE_BYTES, 4_000])
def test_filter_by_many_points(spark, monkeypatch, share):
    """In one share or in several; equal rows stay; other columns go along."""
    monkeypatch.setattr(boxes, "SHARE_BYTES", share)
    rng = np.random.default_rng(6)
    rivals = sorted({tuple(map(float, p)) for p in anti(rng, 500, 3)})
    points = [tuple(map(float, p)) for p in anti(rng, 300, 3) + 0.01 * rng.random((300, 1))] + rivals[:20] + [(NAN, 0.0, 0.0)]
    df = spark.createDataFrame([(*p, f"row {i}") for i, p in enumerate(points)], "a double, b double, c double, text string")
    found = boxes.not_dominated_by(df, ["a", "b", "c"], materialise(spark.createDataFrame(rivals, ["x", "y", "z"]).toDF("a", "b", "c")))
    q = np.array(rivals)
    stays = {i for i, p in enumerate(points) if not ((q <= p).all(1) & (q < p).any(1)).any()}
    # NaN is greater than every number
    assert {int(r.text.split()[1]) for r in found.collect()} - {320} == stays - {320}


@pytest.mark.parametrize("strategy", ["radius_angular", "representatives", "seeded"])
def test_filters_without_broadcast(spark, strategy):
    rng = np.random.default_rng(8)
    points = sorted({tuple(map(float, p)) for p in anti(rng, 500, 3)})
    df = spark.createDataFrame(points, ["a", "b", "c"])
    given = [tuple(map(float, p)) for p in anti(rng, 200, 3)]
    seeds = spark.createDataFrame(given, ["a", "b", "c"])
    if strategy == "radius_angular":
        assert tuples(skyline(df, strategy=strategy, broadcast_rows=0)) == brute(points)
    elif strategy == "representatives":
        q = np.array(given)
        left = [p for p in points if not ((q <= p).all(1) & (q < p).any(1)).any()]
        assert tuples(skyline(df, strategy=strategy, given=seeds, broadcast_rows=0)) == brute(left)
    else:
        found = seeded_skyline(df, ["a", "b", "c"], seeds, broadcast_rows=0)
        best = set(brute(points + given)) - set(given)
        assert tuples(found) == sorted([*given, *best])


@pytest.mark.parametrize("slices", [2, 5])
def test_minima_below(spark, slices):
    rng = np.random.default_rng(slices)
    rows = [(*map(int, c), *map(float, x)) for c, x in zip(rng.integers(0, slices, (60, 3)), rng.random((60, 3)))]
    df = spark.createDataFrame(rows, "c0 int, c1 int, c2 int, x double, y double, z double")
    found = {tuple(r)[:3]: tuple(r)[3:] for r in lattice.minima_below(df, ["c0", "c1", "c2"], ["x", "y", "z"], slices).collect()}
    assert set(found) == {r[:3] for r in rows}
    for cell, least in found.items():
        below = [r[3:] for r in rows if r[:3] != cell and all(a <= b for a, b in zip(r[:3], cell))]
        assert least == (tuple(min(c) for c in zip(*below)) if below else (None,) * 3)


@pytest.mark.parametrize("slices", [2, 4])
@pytest.mark.parametrize("cells", [lattice.LATTICE_CELLS, 1])
def test_grid_parallel_without_broadcast(spark, monkeypatch, slices, cells):
    monkeypatch.setattr(lattice, "LATTICE_CELLS", cells)
    monkeypatch.setattr(boxes, "LEAST_ROWS", 50)
    points = sorted({tuple(map(float, p)) for p in anti(np.random.default_rng(9), 800, 3)})
    df = spark.createDataFrame(points, ["a", "b", "c"])
    found = skyline(df, ["a", "b", "c"], "grid_parallel", slices=slices, broadcast_rows=0)
    assert tuples(found) == brute(points)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_small_boxes_share_a_pass(spark, monkeypatch, keys):
    """What a pass drops is not shipped, and the tasks do not grow with the number of boxes."""
    monkeypatch.setattr(boxes, "WAVES", 1)
    points = sorted({tuple(map(float, p)) for p in anti(np.random.default_rng(11), 600, 3)})
    far = [(1 + i / 4000, 1 + (i * 37 % 4000) / 4000, 1 + (i * 91 % 4000) / 4000) for i in range(4000)]
    rows = [(i % 2, *p) for i, p in enumerate(points)] + [(i % 2, *p) for i, p in enumerate(far)]
    phase = materialise(spark.createDataFrame(rows, "k int, a double, b double, c double"))
    dims = ["a", "b", "c"]
    found = boxes.super_boxes(phase, dims, keys, box_rows=20)
    assert found.rows.rdd.getNumPartitions() == 4
    sizes = [r["count"] for r in found.rows.groupBy(boxes.BOX).count().collect()]
    assert max(sizes) <= 20 and len(sizes) >= len(points) / 20
    assert found.count < len(rows) / 2
    merged = boxes.box_merge(phase, dims, keys, box_rows=20)
    groups = [[r[1:] for r in rows if r[0] == k] for k in (0, 1)] if keys else [[r[1:] for r in rows]]
    expected = sorted(((k, *p) if keys else p) for k, group in enumerate(groups) for p in brute(group))
    assert tuples(merged) == expected


def test_pieces_are_numbered_in_order(spark):
    rows = spark.range(0, 100, 1, 3).withColumn("n", partitioning.piece(10)).collect()
    assert [r.n for r in rows] == sorted(r.n for r in rows)
    assert max(Counter(r.n for r in rows).values()) == 10 and len({r.n for r in rows}) == 12
