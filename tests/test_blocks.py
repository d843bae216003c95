"""The merge by joins of blocks: copies follow the rows that may stay."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pareto_frame.operators import merge, partitioning
from pareto_frame.session import materialise
from tests.brute import skyline as brute
from tests.test_boxes import anti

DIMS = ["a", "b", "c"]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(merge, "BLOCK_ROWS", 40)
    monkeypatch.setattr(partitioning, "TASK_ROWS", 400)


def shape(spark, kind, n):
    rng = np.random.default_rng(n)
    points = rng.random((n, 3)).round(3) if kind == "independent" else anti(rng, n, 3)
    return sorted({tuple(map(float, p)) for p in points})


@pytest.mark.parametrize("kind", ["independent", "anti"])
def test_blocks_of_what_may_stay(spark, small_blocks, kind):
    points = shape(spark, kind, 2000)
    phase = materialise(spark.createDataFrame(points, DIMS))
    blocks = merge.cut_into_blocks(phase, DIMS)
    assert blocks.rdd.getNumPartitions() == 5
    sizes = [r["count"] for r in blocks.groupBy(merge.BLOCK).count().collect()]
    assert sum(sizes) == len(points) and max(sizes) <= 40
    left = merge._below_no_champion(blocks, DIMS, [], [])
    if kind == "independent":
        assert left.count() < len(points) / 2
    assert sorted(map(tuple, merge.block_merge(blocks, DIMS).collect())) == brute(points)


def test_copies_nulls_and_keys(spark, small_blocks):
    points = shape(spark, "independent", 600)
    rows = [(i % 3 or None, *p) for i, p in enumerate(points)] * 2 + [(1, None, 0.0, 0.0), (None, 0.0, None, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    blocks = merge.cut_into_blocks(materialise(df), DIMS, ["k"])
    expected = Counter(rows[-2:])
    for key in (None, 1, 2):
        group = [r[1:] for r in rows[:-2] if r[0] == key]
        for p in brute(group):
            expected[(key, *p)] = 2
    assert Counter(map(tuple, merge.block_merge(blocks, DIMS, ["k"]).collect())) == expected


def test_texts_and_cells(spark, small_blocks):
    points = [(int(4 * a), a, f"{b:.3f}", c) for a, b, c in shape(spark, "independent", 500)]
    df = spark.createDataFrame(points, "cell int, a double, b string, c double")
    blocks = merge.cut_into_blocks(materialise(df), DIMS, lead=[F.col("cell")])
    found = merge.block_merge(blocks, DIMS, cells=["cell"])
    expected = brute([(a, float(b), c) for _, a, b, c in points])
    assert sorted((r.a, float(r.b), r.c) for r in found.collect()) == expected
