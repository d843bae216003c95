"""Bounded windows: overflow passes give the same rows as one unbounded window."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from pareto_frame import skyline
from pareto_frame.operators import local
from pareto_frame.plans import skyline as plans
from pareto_frame.session import materialise, no_derived_constraints
from tests.brute import rows as tuples
from tests.brute import skyline as brute
from tests.test_boxes import anti


@pytest.mark.parametrize("window", [1, 7, 100, 10_000])
def test_same_rows_with_any_window(spark, monkeypatch, window):
    monkeypatch.setattr(local, "_BUFFER_ROWS", 16)
    n = 60 if window == 1 else 500
    points = sorted({tuple(map(float, p)) for p in anti(np.random.default_rng(window), n, 3)})
    df = spark.createDataFrame(points, ["a", "b", "c"]).repartition(3)
    passes = []
    record = plans.materialise
    monkeypatch.setattr(plans, "materialise", lambda *a, **k: (passes.append(k), record(*a, **k))[1])
    assert tuples(skyline(df, strategy="bnl", window=window)) == brute(points)
    windowed = [k for k in passes if k.get("marked")]
    assert len(windowed) == 1 if window == 10_000 else len(windowed) > 1


def test_one_pass_settles_what_it_says(spark, monkeypatch):
    """Per partition: settled tuples are exactly undominated ones, and nothing undominated is lost."""
    monkeypatch.setattr(local, "_BUFFER_ROWS", 16)
    points = [tuple(map(float, p)) for p in anti(np.random.default_rng(2), 400, 3)]
    # dominators come late, so that kept tuples are evicted
    points = sorted(set(points), key=lambda p: -sum(p))
    df = spark.createDataFrame(points, ["a", "b", "c"]).coalesce(1)
    found = local.window_pass(df, ["a", "b", "c"], 9).collect()
    settled = {tuple(r)[:3] for r in found if not r[3]}
    best = set(brute(points))
    assert settled <= best <= {tuple(r)[:3] for r in found}
    assert len(found) == len({tuple(r)[:3] for r in found})


def test_copies_and_no_window(spark):
    df = spark.createDataFrame([(1, 1, i % 2) for i in range(40)], "a int, b int, id int")
    assert skyline(df, ["a", "b"], "bnl", window=1).count() == 40
    with pytest.raises(ValueError, match="window"):
        skyline(df, ["a", "b"], "bnl", window=0)
    empty = skyline(df.filter("id > 5"), ["a", "b"], "bnl", window=3)
    assert empty.collect() == []


def test_first_passes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(local, "_MOST_KEPT", 20)
    monkeypatch.setattr(local, "_BUFFER_ROWS", 16)
    points = sorted({tuple(map(float, p)) for p in anti(np.random.default_rng(4), 400, 3)})
    df = spark.createDataFrame(points, ["a", "b", "c"]).coalesce(1)
    for ordered in (False, True):
        rows = df.sortWithinPartitions("a", "b", "c") if ordered else df
        left = {tuple(r) for r in local.local_skyline(rows, ["a", "b", "c"], presorted=ordered).collect()}
        assert set(brute(points)) <= left
    for strategy in ("auto", "sfs", "sfs_range"):
        assert tuples(skyline(df, strategy=strategy)) == brute(points)


def test_marked_rows_are_counted_in_the_same_job(spark):
    phase = materialise(spark.range(10).withColumn("odd", F.col("id") % 2 == 1), marked="odd")
    assert (phase.count, phase.marked) == (10, 5)
    assert materialise(spark.range(0)).count == 0


def test_the_setting_comes_back_whoever_ends_last(spark):
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    inside, leave = threading.Event(), threading.Event()

    def other():
        with no_derived_constraints(spark):
            inside.set()
            leave.wait(10)

    thread = threading.Thread(target=other)
    with no_derived_constraints(spark):
        thread.start()
        inside.wait(10)
    assert spark.conf.get(key) == "false"
    leave.set()
    thread.join()
    assert spark.conf.get(key) == before
