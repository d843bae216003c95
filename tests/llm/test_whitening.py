"""Whitening against numpy on the same whole numbers."""

from __future__ import annotations

import numpy as np
import pytest

from pareto_frame.llm import whitening

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    full = [(*r, "x", "y") for r in rows]
    schema = "vec_id long, embedding array<double>, index string, values string"
    return spark.createDataFrame(full, schema).repartition(3)


def check(rows, found, k):
    """``rows``: (vec_id, vector) of those that take part; all ids differ."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(rows), x.sum(0)
    centred = np.array((n * x - sums) / n, dtype=float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, len(sums))
    expected = centred @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = {i: int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for (i, _), row in zip(rows, x)}
    at = {i: r for r, (i, _) in enumerate(rows)}
    got = np.full((n, k), np.nan)
    for r in found:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
        assert 0 <= r.identity_error < 1e-9
    assert len(found) == n * k and not np.isnan(got).any()
    signs = np.sign((got * expected).sum(0))
    np.testing.assert_allclose(got * signs, expected, rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("block", [(1024, 1024), (16, 5)])
def test_against_numpy(spark, monkeypatch, block):
    """Odd vectors take no part; with small blocks every product has several in each direction."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block[0])
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", block[1])
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(12, 12))
    good = [(i - 20, [float(c) for c in rng.normal(size=12) @ mix + 3]) for i in range(230)]
    hot = good[0][1]
    good += [(1000 + i, hot) for i in range(60)]
    odd = [(1, None), (2, []), (3, [1.0, None] * 6), (4, [NAN] * 12), (5, [INF] * 12), (6, [1.0, 2.0]), (7, [1e300] * 12)]
    odd = [(5000 + i, v) for i, v in odd]
    found = whitening.components_of(table(spark, good + odd), 7).collect()
    check(good, found, 7)


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(50)]
    check(rows, whitening.components_of(table(spark, rows)).collect(), 3)


def test_no_rows_one_row_equal_rows_and_a_constant_dimension(spark):
    assert whitening.components_of(table(spark, [])).collect() == []
    assert whitening.components_of(table(spark, [(1, None)])).collect() == []
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        found = whitening.components_of(table(spark, rows)).collect()
        assert len(found) == 2 * len(rows)
        assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(len(rows), 0, 0, 0, 0)}
    found = whitening.components_of(table(spark, [(i, [float(i), 7.0]) for i in range(8)])).collect()
    assert {(r.whitened, r.explained) for r in found if r.component == 2} == {(0.0, 0.0)}
    assert all(r.identity_error < 1e-12 for r in found)


def test_null_and_repeated_ids(spark):
    rows = [(None, [0.0, 1.0]), (4, [2.0, 0.5]), (4, [2.0, 0.5]), (None, [-1.0, 0.0])]
    found = whitening.components_of(table(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in found) == ["4"] * 4 + ["None"] * 4


def test_large_entries(spark):
    """Beyond a long, the deviation is null and the rest stays defined."""
    rows = [(i, [float(1 << 50) * (i - 3), float(i * i)]) for i in range(8)]
    found = whitening.components_of(table(spark, rows)).collect()
    assert len(found) == 16 and {r.deviation for r in found} == {None}
    assert all(np.isfinite(r.whitened) for r in found)
