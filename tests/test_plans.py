"""What the physical plans look like, and what the library must not do."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pareto_frame import skyline
from pareto_frame.operators import joins, local
from pareto_frame.plans import skyline as plans
from tests.brute import dominates

LIBRARY = Path(__file__).resolve().parent.parent / "pareto_frame"


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(2000).select(
        "id",
        (F.col("id") % 83).alias("a"),
        (F.col("id") % 89).alias("b"),
        F.lit("payload").alias("text"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_local_pass_reads_only_dimensions(stored):
    plan = plan_of(local.local_skyline(stored.filter("a is not null"), ["a", "b"]))
    assert "MapInArrow" in plan
    assert re.search(r"ReadSchema: struct<a:bigint,b:bigint>", plan)
    assert "Exchange" not in plan


def test_sql_strategy_has_no_python(spark, stored, monkeypatch):
    seen = []
    record = plans.materialise
    keep = lambda df, **named: (seen.append(plan_of(df)), record(df, **named))[1]
    monkeypatch.setattr(plans, "materialise", keep)
    seen.append(plan_of(skyline(stored, ["a", "b"], "sql")))
    assert len(seen) == 2
    assert not any("Python" in plan or "Arrow" in plan for plan in seen)
    assert "LeftAnti" in seen[-1] and "BroadcastNestedLoopJoin" in seen[-1]


def test_sql_frontiers_have_no_python(spark, stored, monkeypatch):
    """Many rows of continuous values: frontiers, no grouping, and more candidates than are broadcast."""
    seen = []
    record = plans.materialise
    keep = lambda df, **named: (seen.append(plan_of(df)), record(df, **named))[1]
    monkeypatch.setattr(plans, "materialise", keep)
    for name, size in (("FEW_ROWS", 100), ("FRONTIER_ROWS", 20), ("LARGER_FRONTIER", 50)):
        monkeypatch.setattr(plans, name, size)
    x = F.col("id").cast("double")
    rows = stored.select(x.alias("d31"), (2000 - x + x * 37 % 400).alias("d57"), (x * 71 % 1999).alias("d71"))
    best = skyline(rows, strategy="sql", broadcast_rows=30)
    seen.append(plan_of(best))
    # two tables for each frontier, and what it leaves
    assert len(seen) >= 7
    assert not any("Python" in plan or "Arrow" in plan for plan in seen)
    assert not any("Aggregate" in plan and "min(d71)" in plan for plan in seen)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, skyline(rows).collect()))


def test_rows_return_by_broadcast_semi_join(stored):
    plan = plan_of(skyline(stored, ["a", "b"]))
    assert "BroadcastHashJoin LeftSemi" in plan
    # the large side is not shuffled
    assert "hashpartitioning" not in plan.split("BroadcastHashJoin")[0]


def test_filter_above_a_skyline_stays_above(stored):
    """Rows that the filter drops still dominate; a filter below would let others in."""
    points = [(i % 83, i % 89) for i in range(2000)]
    best = [p for p in points if not any(dominates(q, p) for q in points)]
    inner = [p for p in points if p[0] > 0]
    best_inner = [p for p in inner if not any(dominates(q, p) for q in inner)]
    above = skyline(stored, ["a", "b"]).filter("a > 0").select("a", "b")
    below = skyline(stored.filter("a > 0"), ["a", "b"]).select("a", "b")
    assert sorted(map(tuple, above.collect())) == sorted(p for p in best if p[0] > 0)
    assert sorted(map(tuple, below.collect())) == sorted(best_inner) != sorted(p for p in best if p[0] > 0)


def test_representative_filter_is_a_broadcast(spark, stored):
    reps = spark.createDataFrame([(3, 3)], "a bigint, b bigint")
    plan = plan_of(joins.survivors(stored, ["a", "b"], reps))
    assert "BroadcastNestedLoopJoin LeftAnti BuildRight" in plan


def test_library_never_collects_or_pins():
    for path in LIBRARY.rglob("*.py"):
        text = path.read_text()
        for word in ("localCheckpoint", ".collect(", ".toPandas(", ".rdd", "crossJoin", ".persist("):
            assert word not in text, f"{word} in {path.name}"
