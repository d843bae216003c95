"""Mergeable states against brute force: rollups, increments, hot groups, types."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pareto_frame import skyline_by
from pareto_frame.operators import local, states
from tests.brute import skyline as brute
from tests.test_boxes import anti


def fields(df, dims):
    return [df.schema[c] for c in dims]


def per_group(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], set()).add(r[1:])
    return Counter((k, *p) for k, ps in groups.items() for p in brute(ps))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(3000) < 0.6, "hot", rng.choice([f"k{i}" for i in range(200)], 3000))
    return [(None if k == "k7" else str(k), *map(float, p)) for k, p in zip(keys, anti(rng, 3000, 3))]


@pytest.mark.parametrize("size, fan, buffer", [(50_000, 16, 32_768), (7, 2, 64), (50_000, 2, 16)])
def test_merged_states_are_the_frontiers(spark, monkeypatch, rows, size, fan, buffer):
    """Also with states, steps and buffers so small that every way is taken."""
    for module, name, value in ((states, "STATE_ROWS", size), (states, "FAN", fan), (local, "_BUFFER_ROWS", buffer)):
        monkeypatch.setattr(module, name, value)
    dims = ["x", "y", "z"]
    df = spark.createDataFrame([*rows, ("hot", None, 0.0, 0.0)], "k string, x double, y double, z double").repartition(9)
    packed = states.skyline_states(df, ["k"], dims)
    assert dict(packed.dtypes) == {"k": "string", "state": "binary"}
    merged = states.merge_states(packed, ["k"], fields(df, dims))
    found = states.state_rows(merged, ["k"], fields(df, dims))
    assert found.columns == ["k", *dims]
    assert Counter(map(tuple, found.collect())) == per_group(rows)
    assert merged.select(F.max(F.length("state"))).first()[0] <= size * 3 * 8
    if size > 1000:
        assert merged.count() == len({r[0] for r in rows})


def test_rollup_and_increment(spark, rows):
    dims = ["x", "y", "z"]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double").withColumn("day", F.length("k") % 2)
    kept = states.merge_states(states.skyline_states(df.filter("x < 0.4"), ["k", "day"], dims), ["k", "day"], fields(df, dims))
    fresh = states.skyline_states(df.filter("x >= 0.4"), ["k", "day"], dims)
    both = states.merge_states(kept.unionByName(fresh), ["k"], fields(df, dims))
    assert Counter(map(tuple, states.state_rows(both, ["k"], fields(df, dims)).collect())) == per_group(rows)
    whole = states.state_rows(states.merge_states(both, [], fields(df, dims)), [], fields(df, dims))
    assert sorted(map(tuple, whole.collect())) == brute({r[1:] for r in rows})


def test_types_come_back(spark):
    df = spark.range(300).select(
        (F.col("id") % 5).alias("k"),
        (F.col("id") * 7 % 23 - 11).cast("decimal(9,2)").alias("m"),
        F.date_add(F.lit("1969-12-20").cast("date"), (F.col("id") * 5 % 29).cast("int")).alias("d"),
        F.timestamp_micros(F.col("id") * 1_000_003 % 97 - 40).alias("t"),
        F.when(F.col("id") % 31 == 0, F.lit(float("nan"))).otherwise((F.col("id") * 3 % 17 - 8) / F.lit(4.0)).cast("float").alias("f"),
        (F.col("id") % 2 == 0).alias("b"),
        (F.col("id") * 11 % 13 - 6).cast("smallint").alias("s"),
    )
    dims = ["m", "d", "t", "f", "b", "s"]
    merged = states.merge_states(states.skyline_states(df, ["k"], dims), ["k"], fields(df, dims))
    found = states.state_rows(merged, ["k"], fields(df, dims))
    assert found.dtypes == df.dtypes
    expected = skyline_by(df, ["k"], dims)
    assert Counter(map(str, found.collect())) == Counter(map(str, expected.collect()))


def test_empty_and_text(spark):
    df = spark.createDataFrame([], "k int, a double, t string")
    merged = states.merge_states(states.skyline_states(df, ["k"], ["a"]), ["k"], fields(df, ["a"]))
    assert merged.collect() == [] and states.state_rows(merged, ["k"], fields(df, ["a"])).collect() == []
    with pytest.raises(ValueError, match="64-bit"):
        states.skyline_states(df, ["k"], ["t"])
