"""Bounds pick plans, never rows; options hold for every number and type of dimensions."""

import datetime
import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pareto_frame import phase_counts, seeded_skyline, skyline, skyline_by
from pareto_frame.functions import geometry
from pareto_frame.operators import joins
from pareto_frame.plans import skyline as plans

NAN = float("nan")
ROWS = [
    (1, 5.0, 5.0), (2, 2.0, None), (3, None, None), (4, 1.0, 9.0), (5, 4.0, 4.0), (6, 4.0, 4.0), (7, 7.0, None), (8, 9.0, 1.0),
]
SEEDS = [(-1, 3.0, 3.0), (-2, 7.0, None), (-3, 7.0, None), (-4, 1.0, 9.0)]
COLUMNS = "id bigint, `x.a` double, b double"


def beats(q, p):
    return None not in (*q, *p) and all(a <= b for a, b in zip(q, p)) and q != p


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bound, nulls", list(itertools.product([0, 100_000], ["drop", "keep"])))
def test_seeds_do_not_depend_on_the_bound(spark, bound, nulls):
    rows, seed = spark.createDataFrame(ROWS, COLUMNS), spark.createDataFrame(SEEDS, COLUMNS)
    dims = ["x.a", F.col("b") * 1.5]
    everything = [r[1:] for r in (*ROWS, *SEEDS)]
    added = [
        r
        for r in ROWS
        if (nulls == "keep" if None in r else not any(beats(q, r[1:]) for q in everything))
    ]
    found = seeded_skyline(rows, dims, seed, nulls=nulls, broadcast_rows=bound)
    assert as_counter(found) == Counter([*SEEDS, *added])
    scaled = lambda r: (r[1], None if r[2] is None else r[2] * 1.5)
    found = seeded_skyline(rows, dims, seed, nulls=nulls, ties="distinct", broadcast_rows=bound)
    assert as_counter(found) == Counter({scaled(r) for r in (*SEEDS, *added)})
    found = seeded_skyline(
        rows, dims, seed, nulls=nulls, ties="distinct", tie_break=["id"], broadcast_rows=bound
    )
    known = {r[1:] for r in SEEDS}
    kept = [r for r in added if r[1:] not in known]
    firsts = {r[1:]: r for r in sorted([*SEEDS, *[r for r in kept if None not in r]], reverse=True)}
    assert as_counter(found) == Counter([*firsts.values(), *[r for r in kept if None in r]])


@pytest.mark.parametrize("bound", [0, 100_000])
@pytest.mark.parametrize("given, dims", [([(5.0,)], ["a"]), ([("b",)], ["t"]), ([(NAN, 0.0)], ["a", "b"])])
def test_given_points_of_any_kind(spark, bound, given, dims):
    rows = [(7.0, 1.0, "c"), (8.0, 2.0, "d"), (NAN, 0.5, "e")]
    df = spark.createDataFrame(rows, "a double, b double, t string")
    types = dict(df.dtypes)
    points = spark.createDataFrame(given, ", ".join(f"g{i} {types[d]}" for i, d in enumerate(dims)))
    found = skyline(df, dims, "representatives", given=points, broadcast_rows=bound).collect()
    # the points beat every row but, in the last case, those of a smaller first value
    assert {r.t for r in found} == ({"c"} if len(dims) == 2 else set())


def test_given_belongs_to_representatives(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(ValueError, match="representatives"):
        skyline(df, ["a"], "grid", given=df)
    with pytest.raises(ValueError, match="per_dim"):
        skyline(df, ["a"], "representatives", given=df, per_dim=3)


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_texts_are_counted_in_bytes(spark, monkeypatch, limit):
    """Wide texts go by shuffle and by blocks, with the same rows."""
    monkeypatch.setattr(joins, "TEXT_BYTES", limit)
    rows = [(f"{i * 7 % 50:02d}" + "x" * 30, i * 11 % 50, i) for i in range(200)]
    df = spark.createDataFrame(rows, "t string, a int, id int")
    best = [r for r in rows if not any(beats(q[:2], r[:2]) for q in rows)]
    assert as_counter(skyline(df, ["t", "a"])) == Counter(best)
    groups = as_counter(skyline_by(df, ["a"], ["t"]))
    assert groups == Counter((a, min(t for t, b, _ in rows if a == b)) for a in {r[1] for r in rows})


def test_groups_with_payload_nulls_and_dots(spark):
    rows = [(k, *r) for k in ("u", None) for r in ROWS]
    df = spark.createDataFrame(rows, "`g.k` string, id bigint, `x.a` double, b double")
    for nulls, ties in itertools.product(["drop", "keep"], ["all", "distinct"]):
        best = [r for r in rows if None not in r[2:] and not any(beats(q[2:], r[2:]) for q in rows)]
        best += [r for r in rows if None in r[2:] and nulls == "keep"]
        found = as_counter(skyline_by(df, ["g.k"], ["x.a", "b"], nulls=nulls, ties=ties))
        assert found == (Counter(best) if ties == "all" else Counter({(r[0], *r[2:]) for r in best}))
    found = as_counter(skyline_by(df, ["g.k"], ["x.a", "b"], tie_break=[-F.col("id")]))
    assert {r[1] for r in found} == {4, 6, 8} and len(found) == 6


def test_phase_counts_keep_nan_and_take_dates(spark):
    df = spark.createDataFrame([(1.0, 1.0), (NAN, 0.5), (3.0, 3.0)], "a double, b double")
    counts = phase_counts(df, ["a", "b"]).first()
    assert (counts.n_rows, counts.n_skyline) == (3, 2)
    day = datetime.date(2020, 1, 1)
    dated = spark.createDataFrame([(day, 1.0), (day + datetime.timedelta(1), 2.0)], "`a.d` date, b double")
    assert phase_counts(dated, ["a.d", F.col("b") * 2]).first().n_skyline == 1


def test_wide_ids(spark):
    digits = [i % 7 for i in range(16)]
    cell = geometry.cell_id([F.lit(d) for d in digits], 32)
    df = spark.range(1).select(cell.alias("cell"))
    assert int(df.first().cell) == sum(d * 32**i for i, d in enumerate(digits))
    back = df.select(*[c.alias(f"c{i}") for i, c in enumerate(geometry.cell_digits(F.col("cell"), 16, 32))]).first()
    assert list(back) == digits
    angles = geometry.angular_bucket([F.lit(0.5)] * 16, 32)
    assert spark.range(1).select(angles).first()[0] > 2**63
    with pytest.raises(ValueError, match="slices"):
        geometry.cell_id([F.lit(0)] * 40, 32)


@pytest.mark.parametrize("strategy", ["representatives", "grid_filter", "grid_parallel", "three_phase", "sfs", "sql"])
def test_input_is_read_twice_at_most(spark, tmp_path, strategy):
    path = str(tmp_path / "rows")
    spark.range(3000).select(
        *[((F.col("id") * p) % 97).cast("double").alias(f"d{p}") for p in (31, 57, 71)]
    ).write.parquet(path)
    read = spark.sparkContext.accumulator(0)
    # a Python filter counts the rows that pass the scan
    count = F.udf(lambda x: (read.add(1), True)[1], "boolean").asNondeterministic()
    df = spark.read.parquet(path).filter(count("d31"))
    rows = skyline(df, ["d31", "d57", "d71"], strategy).collect()
    assert rows
    assert read.value <= (3 if strategy == "sql" else 2) * 3000


def test_cells_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.range(500).select(*[((F.col("id") * p) % 53).alias(f"d{p}") for p in (7, 11, 13)])
    expected = as_counter(skyline(df, strategy="sql"))
    monkeypatch.setattr(plans, "BROADCAST_CELLS", 3)
    monkeypatch.setattr(joins, "SHARE_ROWS", 7)
    for bound in (5, 100_000):
        assert as_counter(skyline(df, strategy="grid_filter", slices=16, broadcast_rows=bound)) == expected
        assert as_counter(skyline(df, strategy="grid_parallel", slices=4, broadcast_rows=bound)) == expected
