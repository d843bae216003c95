"""The task function of the local pass, without Spark."""

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pareto_frame.operators import local
from tests.brute import dominates, skyline


def run(columns, n_keys=0, presorted=False, batch=7):
    names = [f"c{i}" for i in range(len(columns))]
    batches = [
        pa.record_batch([c.slice(i, batch) for c in columns], names=names)
        for i in range(0, len(columns[0]), batch)
    ]
    found = local._frontier_of_partition(iter(batches), n_keys, presorted)
    return [tuple(r.values()) for b in found for r in b.to_pylist()]


@pytest.fixture(autouse=True)
def small_buffers(monkeypatch):
    monkeypatch.setattr(local, "_BUFFER_ROWS", 20)
    monkeypatch.setattr(local, "_BLOCK_ROWS", 8)
    monkeypatch.setattr(local, "_PANEL_ROWS", 16)


def tuples_of(dims):
    return st.lists(st.tuples(*[st.integers(-6, 6)] * dims), min_size=0, max_size=120)


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 5).flatmap(tuples_of))
def test_eviction_matches_definition(points):
    if not points:
        return
    columns = [pa.array([p[i] for p in points], pa.int64()) for i in range(len(points[0]))]
    assert sorted(run(columns)) == sorted(set(skyline(points)))


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 5).flatmap(tuples_of))
def test_presorted_matches_definition(points):
    if not points:
        return
    points = sorted(points)
    columns = [pa.array([p[i] for p in points], pa.int64()) for i in range(len(points[0]))]
    assert sorted(run(columns, presorted=True)) == sorted(set(skyline(points)))


@settings(max_examples=120, deadline=None)
@given(tuples_of(4))
def test_groups_match_definition(points):
    if not points:
        return
    keys = [(None if p[0] > 4 else str(p[0]), p[1] // 4) for p in points]
    columns = [
        pa.array([k[0] for k in keys], pa.string()),
        pa.array([k[1] for k in keys], pa.int32()),
        pa.array([p[2] for p in points], pa.int64()),
        pa.array([p[3] for p in points], pa.int64()),
    ]
    expected = set()
    for key in set(keys):
        group = [p[2:] for k, p in zip(keys, points) if k == key]
        expected |= {(*key, *p) for p in skyline(group)}
    found = run(columns, n_keys=2)
    assert len(found) == len(set(found)) and set(found) == expected


def spark_order(value):
    return (1, 0.0) if math.isnan(value) else (0, value + 0.0)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.tuples(*[st.sampled_from([math.nan, math.inf, -math.inf, 0.0, -0.0, 1.5, -2.0])] * 3),
        min_size=1,
        max_size=60,
    )
)
def test_special_floats_follow_sort_order(points):
    columns = [pa.array([p[i] for p in points], pa.float64()) for i in range(3)]
    keyed = [tuple(spark_order(v) for v in p) for p in points]
    expected = {p for p in keyed if not any(dominates(q, p) for q in keyed)}
    found = [tuple(spark_order(v) for v in r) for r in run(columns)]
    assert set(found) == expected and len(found) == len(expected)


def test_large_integers_and_decimals_stay_exact():
    big = 2**60
    ints = [pa.array([big + 1, big, big + 1]), pa.array([1, 1, 0])]
    assert sorted(run(ints)) == [(big, 1), (big + 1, 0)]
    values = [Decimal("1.000000000000001"), Decimal("1.000000000000000"), Decimal("-3")]
    kind = pa.decimal128(18, 15)
    decimals = [pa.array(values, kind), pa.array([5, 5, 9])]
    assert sorted(run(decimals)) == [(Decimal("-3"), 9), (Decimal("1"), 5)]


def test_many_groups_and_one_large_group():
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 900, 3000))
    xy = rng.integers(0, 40, (3000, 2))
    found = set(run([pa.array(keys), pa.array(xy[:, 0]), pa.array(xy[:, 1])], n_keys=1, batch=500))
    expected = set()
    for key in np.unique(keys):
        expected |= {(int(key), *p) for p in skyline([tuple(map(int, r)) for r in xy[keys == key]])}
    assert found == expected


def test_group_codes():
    """Equal codes for equal keys, in any number of columns, with nulls, NaN and both zeros."""
    rng = np.random.default_rng(12)
    texts = [None if x == 0 else f"k{x}" for x in rng.integers(0, 6, 500)]
    numbers = [[None, -0.0, 0.0, float("nan"), 2.5][x] for x in rng.integers(0, 5, 500)]
    days = [int(x) for x in rng.integers(0, 3, 500)]
    columns = [pa.chunked_array([pa.array(c)]) for c in (texts, numbers, days)]
    for used in ([0], [1], [0, 1], [0, 1, 2]):
        codes = local._group_codes([columns[i] for i in used])
        rows = [tuple("0" if (v := (texts, numbers, days)[i][r]) == 0 and i == 1 else str(v) for i in used) for r in range(500)]
        assert len(set(codes.tolist())) == len(set(rows)) == len(set(zip(codes.tolist(), rows)))
