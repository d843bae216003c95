"""Phases of a run, and grids of experiments that go on where they ended."""

import pytest
from pyspark.sql import functions as F

from pareto_frame import STRATEGIES, grid_of, run_grid, skyline, skyline_with_phases
from pareto_frame.plans import jobs
from pareto_frame.session import materialise, recorded_phases
from pareto_frame.sources.generate import generate_points


@pytest.fixture(scope="module")
def points(spark):
    return materialise(generate_points(spark, 3000, "anti_correlated", dims=3, spread=100.0)).rows


@pytest.mark.parametrize("strategy", sorted(STRATEGIES))
def test_phases_shrink_to_the_result(spark, points, strategy):
    holes = points.unionByName(points.limit(7).withColumn("x0", F.lit(None).cast("double")))
    rows, phases = skyline_with_phases(holes, ["x0", "x1", "x2"], strategy)
    steps = phases.orderBy("step").collect()
    assert steps[0].phase == "input" and steps[0].n_rows == 3000
    assert steps[-1].phase == "skyline" and steps[-1].n_rows == rows.count() == skyline(points, ["x0", "x1", "x2"]).count()
    # rows that go on from one phase to the next; points taken as filters are beside them
    through = [s.n_rows for s in steps if s.phase in ("input", "first pass", "filtered", "local skylines", "skyline")]
    assert through == sorted(through, reverse=True)


def test_phases_of_the_representatives(spark, points):
    _, phases = skyline_with_phases(points, ["x0", "x1", "x2"], "representatives", per_dim=4)
    found = {r.phase: r.n_rows for r in phases.collect()}
    assert list(found) == ["input", "first pass", "representatives", "filtered", "local skylines", "skyline"]
    assert 0 < found["representatives"] <= 12


def test_only_the_block_is_recorded(spark):
    with recorded_phases() as outer:
        materialise(spark.range(3), phase="a")
        with recorded_phases() as inner:
            materialise(spark.range(4), phase="b")
        materialise(spark.range(5))
    materialise(spark.range(6), phase="c")
    assert (outer, inner) == ([("a", 3)], [("b", 4)])


def test_a_grid_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    cases = grid_of(["independent", "anti_correlated"], [200, 400], [2, 3], ["auto", "sfs_range"], ["none", "half_open"])
    assert len(cases) == 32 and len({c.name for c in cases}) == 32
    cases = cases[:6]
    ran = []
    run = jobs._run_case
    monkeypatch.setattr(jobs, "_run_case", lambda s, c, p: (ran.append(c), run(s, c, p))[1])
    make = lambda c: generate_points(spark, c.n, c.kind, dims=c.dims)
    first = run_grid(spark, cases[:4], make, str(tmp_path)).collect()
    assert len(first) == len(ran) == 4
    rows = run_grid(spark, cases, make, str(tmp_path)).collect()
    assert len(rows) == 6 and ran == cases
    for r in rows:
        points = generate_points(spark, r.n, r.kind, dims=r.dims)
        assert r.n_input == r.n and r.candidates >= r.size
        assert r.size == skyline(points, [f"x{i}" for i in range(r.dims)], ties="distinct").count()
