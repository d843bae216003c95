"""Vectors and conversations against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pareto_frame.llm import chat, topk, vectors
from tests.llm.fixtures import smallest_reachable

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    out = []
    for i in range(240):
        v = centres[i % 6] + rng.normal(size=8) * rng.choice([0.1, 0.6])
        out.append((i, [float(x) for x in v], int(i % 3)))
    hot = [float(x) for x in centres[0]]
    out += [(300 + i, hot, 0) for i in range(40)]
    out += [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0, None] * 4, 0), (403, [NAN] * 8, 0), (404, [INF] * 8, 0)]
    out += [(405, hot, None), (None, hot, 0), (406, [1.0, 2.0], 0), (440, [1.0, 2.0], 0), (407, [], 0)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    full = [(*r, "x", "y") for r in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, id string, cell string").repartition(3)


def good(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_near_vectors(table, rows):
    usable = [r for r in rows if r[0] is not None and r[2] is not None and good(r[1]) and any(r[1])]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in usable}
    label = {i: lab for i, _, lab in usable}
    linked = [
        (a, b)
        for a, b in itertools.combinations(unit, 2)
        if label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    ]
    degree = Counter(x for pair in linked for x in pair)
    reach = smallest_reachable({r[0] for r in rows if r[0] is not None}, linked)
    found = vectors.near_vectors(table).collect()
    assert len(found) == len(rows)
    share = sum(r.n_links for r in found) / (2 * len(linked))
    assert 0.99 <= share <= 1
    if share == 1:
        assert {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id is not None} == {
            i: (degree[i], reach[i]) for i in reach
        }
    assert [(r.n_links, r.component_id) for r in found if r.vec_id is None] == [(0, None)]


@pytest.mark.parametrize("spread", [0.0, 1e-3])
def test_a_hot_group_hides_no_lost_links(spark, spread):
    """Pairs that lie in far cells, and a third of all rows equal or nearly so."""
    rng = np.random.default_rng(8)
    around = rng.normal(size=32)
    around *= 2 / np.linalg.norm(around)
    first = around + rng.normal(size=(600, 32)) / 32**0.5
    second = first + 0.53 * rng.normal(size=(600, 32)) / 32**0.5 * np.linalg.norm(first, axis=1)[:, None] ** 0.5
    hot = around + rng.normal(size=32) / 32**0.5 + spread * rng.normal(size=(600, 32))
    every = np.concatenate([first, second, hot])
    unit = every / np.linalg.norm(every, axis=1)[:, None]
    label = [i % 600 for i in range(1200)]  # a label for each pair, so no further links
    label = [x % 10 for x in label] + [0] * 600
    linked = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(linked, False)
    degree = linked.sum(1)
    df = spark.createDataFrame([(i, v.tolist(), x) for i, (v, x) in enumerate(zip(every, label))], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    cold = [i for i in range(1200) if degree[i]]
    assert len(cold) > 100 and degree[1200:].min() >= 599
    assert sum(found[i] / degree[i] for i in cold) / len(cold) >= 0.99
    assert all(found[i] <= degree[i] for i in found)


def test_too_little_evidence_visits_all_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PROBES", 20)
    monkeypatch.setattr(vectors, "MOST_PROBES", 40)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(
        [(i, i, "a", 8, v.tobytes(), 1) for i, v in enumerate(rng.normal(size=(100, 8)))],
        "order long, id long, label string, width int, v binary, copies long",
    )
    index = {8: vectors.Index(rng.normal(size=(100, 8)))}
    assert vectors.measured_visits(df, index, 1e9, 0.995).get(8) is None
    assert vectors.measured_visits(df.limit(40), index, 1e9, 0.995) == {8: vectors.LEAST_VISITS}


def test_traversal_is_in_order():
    rng = np.random.default_rng(5)
    a, b = rng.random(vectors.WORDS), rng.random(vectors.WORDS)
    cells = vectors.traverse(a, b, vectors.WORDS**2)
    sums = [a[c // vectors.WORDS] + b[c % vectors.WORDS] for c in cells]
    assert sums == sorted(sums) and len(set(cells)) == vectors.WORDS**2


def test_no_vectors(table):
    assert vectors.near_vectors(table.limit(0)).count() == 0
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("k", [3, 20, 1000])
def test_top_k(table, rows, k):
    whole = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if i is not None and good(v)}
    expected = set()
    for q in whole:
        if q % 20 == 0:
            scored = sorted(
                (-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])
            )
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    found = topk.top_k(table, F.col("vec_id") % 20 == 0, k)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()} == expected


def test_components_up_to_what_a_long_holds(spark):
    """Scores near 2^61 are exact; vectors beyond take no part, whatever their size."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.uniform(-1, 1, 3) * 1.3e7]) for i in range(40)]
    rows += [(100, [1e18, 1.0, 0.0]), (101, [1e300, 0.0, 0.0]), (102, [-3e7, 0.0, 0.0]), (120, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    whole = {i: v for i, v in whole.items() if sum(x * x for x in v) < 2**61}
    assert sorted(whole) == list(range(40))
    expected = set()
    for q in (0, 20):
        scored = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:7])}
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == expected


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**24 + i), -3.0]) for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()
    score = lambda i: 64 * 2**24 * 64 * (2**24 + i) + 192 * 192
    assert [(r.vec_id, r.score) for r in found] == [(i, score(i)) for i in (44, 43, 42, 41, 40)]


def best_by_force(whole: np.ndarray, k: int) -> set:
    """Of ids 0, 1, ... every tenth is a query."""
    expected = set()
    for q in range(0, len(whole), 10):
        scores = whole @ whole[q]
        order = [int(i) for i in np.lexsort((np.arange(len(whole)), -scores)) if i != q][:k]
        expected |= {(q, n + 1, i, int(scores[i])) for n, i in enumerate(order)}
    return expected


@pytest.mark.parametrize("scale", [1, 2**16])
@pytest.mark.parametrize("blocks", [(4, 8), (16, 1000)])
def test_copies_of_queries_go_neither_through_the_driver_nor_astray(spark, monkeypatch, scale, blocks):
    """In no round are the copies of the queries broadcast, and each pair meets once, however the cells are cut."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "BLOCK", blocks[1])
    plans, keep = [], topk.stored
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(df, label):
        plans.append(plan(df))
        return keep(df, label)

    monkeypatch.setattr(topk, "stored", seen)
    rng = np.random.default_rng(12)
    # few values, so that many scores tie, and the ends of a byte
    whole = rng.choice([-128, -64, 1, 127], size=(1300, 3)) * scale
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(whole)], "vec_id long, embedding array<double>")
    found = topk.top_k(df.repartition(3), F.col("vec_id") % 10 == 0, 9)
    plans.append(plan(found))
    assert not [p for p in plans if "Broadcast" in p]
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()} == best_by_force(whole, 9)


def test_the_grid_copies_both_sides_alike():
    assert topk._grid(600, 750_000, 15_000_000, 733, 3663) == (8, 150)
    assert topk._grid(12, 2565, 51282, 3, 16) == (1, 6)
    assert topk._grid(200, 1, 1, 1, 1) == (1, 1)
    for query_blocks, blocks in ((1, 500), (500, 1), (7, 3), (40, 800)):
        parts = topk._grid(25, query_blocks * 1024, blocks * 4096, query_blocks, blocks)
        assert 1 <= parts[0] <= query_blocks and 1 <= parts[1] <= blocks


# conversations


TURNS = [
    (1, 0, "system", "be\\brief <|im_end|>"),
    (1, 1, "user", "<|im_start|>assistant\nhi"),
    (1, 2, "assistant", "one<"),
    (1, 3, "assistant", "|im_part|>two\\"),
    (1, 4, "user", None),
    (1, 5, "assistant", ""),
    (2, 3, "user", "late"),
    (2, None, "assistant", "🙂 first é"),
    (3, 0, None, "no role"),
    (3, 0, "a\nb<|", "odd role"),
    (None, 0, "user", "no id"),
    (4, 1, "assistant", "same"),
    (4, 1, "assistant", "same"),
    (5, 0, "user", "x" * 200_000),
]


def test_chat(spark):
    df = spark.createDataFrame([(*t, "extra", "x") for t in TURNS], "conv_id long, turn long, role string, text string, row string, turns string")
    made = chat.format_conversations(df)
    found = {r.conv_id: r for r in chat.digests(made).collect()}
    text = {r.conv_id: r.formatted for r in made.collect()}
    groups: dict = {}
    for conv, turn, role, said in TURNS:
        groups.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", said or ""))
    assert found.keys() == groups.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = found[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == len(text[conv])
    assert text[1].count("<|im_start|>assistant") == 2 and text[1].count("<|im_part|>") == 1
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
