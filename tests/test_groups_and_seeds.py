import random

from pyspark.sql import functions as F

from pareto_frame import phase_counts, seeded_skyline, skyline_by, sweep_sizes
from pareto_frame.operators import aggregates, merge
from pareto_frame.sources.generate import generate_points
from tests import brute


def grouped_rows(n, seed=3):
    rng = random.Random(seed)
    # one group holds half of the rows, and there are many small ones
    return [
        (None if g == 7 else g, rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 30))
        for g in (0 if rng.random() < 0.5 else rng.randint(1, 40) for _ in range(n))
    ]


def expected_groups(rows):
    found = []
    for g in {r[0] for r in rows}:
        found += [(g, *p) for p in set(brute.skyline(r[1:] for r in rows if r[0] == g))]
    return sorted(found, key=str)


def test_groups(spark, monkeypatch):
    rows = grouped_rows(900)
    df = spark.createDataFrame(rows, "g int, a int, b int, c int")
    want = expected_groups(rows)

    def found(**settings):
        result = skyline_by(df, ["g"], ["a", "b", "c"], **settings)
        return sorted((tuple(r) for r in result.collect()), key=str)

    assert found() == want
    assert found(strategy="aggregate") == want
    monkeypatch.setattr(merge, "BLOCK_ROWS", 50)
    assert found(broadcast_rows=1) == want
    monkeypatch.setattr(aggregates, "FOLD_ROWS", 20)
    assert found(strategy="aggregate", broadcast_rows=1) == want


def test_groups_of_text_dimensions(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (1, "b", "y"), (2, "z", "z")], "g int, s string, t string")
    found = skyline_by(df, ["g"], ["s", "t"])
    assert brute.rows(found) == [(1, "a", "y"), (1, "b", "x"), (2, "z", "z")]


def test_fold_runs_several_levels(spark):
    points = generate_points(spark, 3000, "independent", dims=3)
    names = ["x0", "x1", "x2"]
    found = aggregates.skyline_aggregate(points, names, fold_rows=100)
    expected = brute.skyline(tuple(r) for r in points.select(*names).collect())
    assert brute.rows(found) == expected


def test_fold_falls_back_to_joins(spark):
    rows = [(i, 300 - i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert brute.rows(aggregates.skyline_aggregate(df, ["a", "b"], fold_rows=10)) == sorted(rows)


def test_pack_cells_bounds_chunks(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 5).alias("cell"),
        (F.col("id") % 300).alias("a"),
    )
    packed = aggregates.pack_cells(df, "cell", ["a"], chunk_rows=50)
    sizes = packed.select(F.size("points").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert sizes[0] < 150 and sizes[1] > 5
    total = packed.select(F.inline("points")).agg(F.sum("copies")).first()[0]
    assert total == 1000


def test_seed_stays_and_filters(spark):
    df = spark.createDataFrame([(5, 5), (4, 9), (1, 1), (3, 3)], "a int, b int")
    seed = spark.createDataFrame([(3, 3), (9, 9)], "a int, b int")
    # (9, 9) is dominated, but seeds are never evicted
    assert brute.rows(seeded_skyline(df, ["a", "b"], seed)) == [(1, 1), (3, 3), (9, 9)]
    # a row that equals a seed is a tie, and (1, 1) beats it
    df = spark.createDataFrame([(5, 5), (4, 9), (3, 3), (2, 4)], "a int, b int")
    for bound in (100, 0):
        found = seeded_skyline(df, ["a", "b"], seed, broadcast_rows=bound)
        assert brute.rows(found) == [(2, 4), (3, 3), (3, 3), (9, 9)]
        found = seeded_skyline(df, ["a", "b"], seed, ties="distinct", broadcast_rows=bound)
        assert brute.rows(found) == [(2, 4), (3, 3), (9, 9)]


def test_empty_seed(spark):
    df = spark.createDataFrame([(5, 5), (4, 9)], "a int, b int")
    assert brute.rows(seeded_skyline(df, ["a", "b"], df.limit(0))) == [(4, 9), (5, 5)]


def test_phase_counts_shrink(spark):
    counts = phase_counts(generate_points(spark, 2000, dims=3), ["x0", "x1", "x2"]).first()
    assert counts.n_rows == 2000
    assert counts.n_rows > counts.n_filtered >= counts.n_local >= counts.n_skyline > 0


def test_sweep(spark):
    inputs = {str(n): generate_points(spark, n, dims=2) for n in (10, 500)}
    lines = sweep_sizes(inputs, ["x0", "x1"], ["auto", "sql"]).collect()
    assert [line.n for line in lines] == [10, 10, 500, 500]
    assert lines[0].size == lines[1].size and lines[2].size == lines[3].size
    assert all(line.seconds > 0 for line in lines)
