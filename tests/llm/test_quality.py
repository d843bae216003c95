"""Random-indexing vectors against plain sums; accuracy and calibration on held-out documents."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pareto_frame.llm import quality
from tests.llm.fixtures import documents, odd_rows

FOLDER = "/root/testdata/sf0.1"


def plain_words(text: str) -> list[str]:
    """Runs of letters, digits and other signs."""
    kind = lambda c: "a" if c.isalpha() else "d" if c.isdigit() else " " if c.isspace() else "o"
    marks = "".join(kind(c) for c in text)
    return [text[m.start() : m.end()] for m in re.finditer("a+|d+|o+", marks)]


def plain_sums(texts) -> np.ndarray:
    index, out = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.WIDTH), np.int64)
    for text in texts:
        buckets = [int(quality._words(w)[0]) for w in plain_words(text or "")]
        for i, b in enumerate(buckets):
            for j in range(max(0, i - quality.WINDOW), min(len(buckets), i + quality.WINDOW + 1)):
                if j != i:
                    out[b] += index[buckets[j]]
    return out


def test_words():
    text = "Some words, WORDS words!! 12ab  naïve Σς \x1c 中文 🙂"
    assert quality._words(text).tolist() == [int(quality._words(w)[0]) for w in plain_words(text)]
    shapes = [int(quality._words(w)[0]) for w in ("word", "Word", "WORD", "wOrd")]
    assert len(set(shapes)) == 4
    assert len(quality._words(" \n\t")) == 0


def test_index_vectors_are_sparse_and_balanced():
    index = quality.index_vectors()
    assert (np.abs(index[:-1]).sum(1) == quality.NONZERO).all() and not index[-1].any()
    assert np.abs(index.mean()) < 0.01


def test_context_sums_are_those_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "BATCH", 500)
    expected = plain_sums(t for _, t in odd_rows())
    assert (quality.context_sums(documents(spark)) == expected).all()
    assert not quality.context_sums(documents(spark, [])).any()


def test_word_vectors():
    sums = np.zeros((quality.BUCKETS, quality.WIDTH), np.int64)
    sums[3, 4], sums[5, 6] = 8, -2
    vectors = quality.word_vectors(sums)
    assert np.allclose(np.linalg.norm(vectors[[3, 5]], axis=1), 1) and np.abs(vectors).sum(1).astype(bool).sum() == 2
    assert not quality.word_vectors(np.zeros_like(sums)).any()


def test_pooling_goes_over_the_whole_text(monkeypatch):
    vectors = quality.word_vectors(plain_sums(t for _, t in odd_rows()))
    text = "the of and " * 400
    whole = quality.pooled(text, vectors)
    assert np.isclose(whole[-1], np.log1p(1200))
    monkeypatch.setattr(quality, "STRETCH", 110)
    assert np.allclose(quality.pooled(text, vectors)[: quality.WIDTH], whole[: quality.WIDTH])
    assert not quality.pooled(None, vectors).any() and not quality.pooled("", vectors).any()


def test_odd_tables(spark):
    """Nulls, no labels, one label, repeated and unusable labels, very long texts, clashing names."""
    docs = documents(spark, [*odd_rows(), (7777, "word " * 300_000)]).withColumns({"quality": F.lit("x"), "predicted": F.lit("y"), "features": F.lit(1)})
    schema = "doc_id long, quality int, toxic int, text string"
    n = docs.count()
    none = quality.train(docs, spark.createDataFrame([], schema))
    rows = quality.score(docs, none).collect()
    assert len(rows) == n and {round(r.score, 9) for r in rows} == {0.5}
    assert rows[0].quality == "x" and {r.predicted for r in rows} == {1}
    ones = [(i, 1, 0, "z") for i, _ in odd_rows() if i is not None] * 2
    one = quality.train(docs, spark.createDataFrame(ones + [(None, 0, 0, "z"), (4, None, 0, "z"), (4, 9, 0, "z")], schema))
    assert len({round(r.score, 9) for r in quality.score(docs, one).collect()}) == 1
    both = [(i, k % 2, 0, "z") for k, (i, _) in enumerate(odd_rows()) if i is not None]
    scores = [r.score for r in quality.score(docs, quality.train(docs, spark.createDataFrame(both, schema))).collect()]
    assert len(scores) == n and all(0 <= s <= 1 for s in scores)
    empty = quality.train(documents(spark, []), spark.createDataFrame([], schema))
    assert quality.score(documents(spark, []), empty).count() == 0


def test_the_sample_is_bounded_and_not_held_out(spark):
    docs = documents(spark, [(i, f"word {i}") for i in range(200)]).unionByName(documents(spark, [(1, "again")] * 50))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    vectors = quality.word_vectors(quality.context_sums(docs))
    few = quality.labelled_sample(docs, labels, vectors, quality.Settings(rows=60)).collect()
    assert len(few) == 60
    kept = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    every = quality.labelled_sample(docs, labels, vectors, quality.Settings()).collect()
    assert len(every) == len(kept) + 50 * (1 in kept)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = quality.score(docs, quality.train(docs, labels))
    rows = found.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    truth, score = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    rank = score.argsort().argsort() + 1
    good = truth == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.99
    assert np.mean((score >= 0.3) == good) > 0.98
    assert abs(score.mean() - truth.mean()) < 0.02
    for low, high in ((0, 0.2), (0.8, 1.01)):
        some = (score >= low) & (score < high)
        assert abs(score[some].mean() - truth[some].mean()) < 0.03
