"""Quality scores from random-indexing word vectors and a two-layer network.

1. *Word vectors by random indexing.* Each word (a run of letters, of digits, or of other signs, with its
   case pattern) is hashed into one of ``BUCKETS`` rows and owns a sparse random index vector of
   ``NONZERO`` entries of +1 or -1. A word's vector is the sum of the index vectors of the words at
   most ``WINDOW`` places away, over all documents. Tasks add up whole numbers in one table of fixed size;
   the tables are summed block by block, so the order of tasks does not matter. Vectors are scaled to
   length one, centred and scaled again.
2. *Pooling.* A document is the mean and the spread of its words' vectors, the mean product of
   neighbouring ones (which tells repetition), and the logarithm of its number of words.
3. *Network.* One hidden layer of tanh units and a logistic output, trained in numpy on at most
   ``Settings.rows`` labelled documents, those of smallest hashed id. Every fifth of them is held back
   to fit a temperature, so that the score is a calibrated probability of label 1.

Only labels are bounded; the vectors cover all documents. The driver holds one table of
``BUCKETS * WIDTH`` numbers and the pooled sample.

Defined cases: null and empty texts have no words and are scored as such, like all others between 0 and 1;
labels other than 0 and 1, labels of null ids and of held-out ids are not used; repeated labels and repeated rows are
examples each, as far as the bound goes; without both labels among the examples the score is their smoothed share
for every text (0.5 without any). Texts are read whole, in stretches of ``STRETCH`` characters (a
word across two of them counts as two). Further columns are kept; ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareto_frame.llm.common import shuffle_partitions
from pareto_frame.llm.language import held_out

BITS, WIDTH, NONZERO, WINDOW = 15, 32, 4, 2
BUCKETS = 1 << BITS
#: Rows of the table in one shuffled block.
BLOCK = 1 << 10
STRETCH = 1 << 18
#: Words that are counted at once.
BATCH = 1 << 18
FEATURES = 3 * WIDTH + 1


@dataclass(frozen=True)
class Settings:
    rows: int = 8000
    hidden: int = 32
    epochs: int = 40
    rate: float = 2e-3
    decay: float = 1e-4
    batch: int = 32
    threshold: float = 0.3
    seed: int = 5


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: 0 space, 1 letter, 2 digit, 3 other; its lower case; whether it is upper case."""
    kind, lower, upper = np.full(0x110000, 3, np.uint8), np.arange(0x110000, dtype=np.uint64), np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            kind[c] = 1
            if x.isupper():
                lower[c], upper[c] = ord(x.lower()[0]), 1
        elif x.isdigit():
            kind[c] = 2
        elif x.isspace():
            kind[c] = 0
    return kind, lower, upper


@cache
def index_vectors() -> np.ndarray:
    """The random index vector of every bucket; one more row of zeros stands between texts."""
    rng = np.random.default_rng(BUCKETS)
    places = rng.random((BUCKETS, WIDTH)).argsort(1)[:, :NONZERO]
    table = np.zeros((BUCKETS + 1, WIDTH), np.int16)
    np.put_along_axis(table[:-1], places, rng.choice(np.array([-1, 1], np.int16), (BUCKETS, NONZERO)), 1)
    return table


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def stretches(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of the words of a text, in order, stretch by stretch."""
    for at in range(0, len(text or ""), STRETCH):
        yield _words(text[at : at + STRETCH])


def _words(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, lowers, uppers = _characters()
    kind = kinds[codes]
    starts = np.flatnonzero((kind != 0) & (kind != np.concatenate([[0], kind[:-1]])))
    if not len(starts):
        return np.zeros(0, np.int64)
    there = kind != 0
    owner = np.cumsum(np.bincount(starts, minlength=len(codes))) - 1
    place = (np.arange(len(codes)) - starts[owner]).astype(np.uint64)
    # a sum over places: the same characters elsewhere give another one
    each = np.where(there, _mixed(lowers[codes] * np.uint64(0x100000001B3) + place * np.uint64(0xD6E8FEB86659FD93)), 0)
    h = np.add.reduceat(each, starts)
    upper = uppers[codes]
    shouted, length = np.add.reduceat(upper.astype(np.int64), starts), np.add.reduceat(there.astype(np.int64), starts)
    pattern = np.where(shouted == 0, 0, np.where(shouted == length, np.where(length == 1, 1, 2), np.where((shouted == 1) & (upper[starts] == 1), 1, 3)))
    return (_mixed(h + pattern.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - BITS)).astype(np.int64)


# word vectors


def add_contexts(table: np.ndarray, words: np.ndarray) -> None:
    """Add to each word's row the index vectors of its neighbours; ``BUCKETS`` stands between texts."""
    index = index_vectors()[words]
    near = np.zeros(index.shape, np.int32)
    for d in range(1, WINDOW + 1):
        near[d:] += index[:-d]
        near[:-d] += index[d:]
    order = np.argsort(words, kind="stable")
    own = words[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    table[own[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table of sums for all texts of a task, in blocks; blocks without a word are left out."""
    table = np.zeros((BUCKETS + 1, WIDTH), np.int64)
    gap = np.full(WINDOW, BUCKETS)
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            for words in stretches(text.as_py()):
                held += [words, gap]
                size += len(words) + WINDOW
                if size >= BATCH:
                    add_contexts(table, np.concatenate(held))
                    held, size = [], 0
    if held:
        add_contexts(table, np.concatenate(held))
    yield from _as_blocks({b: table[b * BLOCK : (b + 1) * BLOCK] for b in range(BUCKETS // BLOCK)})


def _as_blocks(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for number, rows in blocks.items():
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([rows.tobytes()])], ["block", "sums"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of equal number added up as they arrive; a task holds each block once."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = np.frombuffer(sums.as_buffer(), np.int64).reshape(BLOCK, WIDTH)
            blocks[number] = blocks[number] + rows if number in blocks else rows
    yield from _as_blocks(blocks)


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For every bucket the sum of its neighbours' index vectors over all documents."""
    blocks = "block int, sums binary"
    parts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_contexts, blocks)
    tasks = min(BUCKETS // BLOCK, shuffle_partitions(docs.sparkSession))
    table = np.zeros((BUCKETS, WIDTH), np.int64)
    # at most BUCKETS / BLOCK rows, whatever the number of documents
    for row in parts.repartition(tasks, "block").mapInArrow(_summed, blocks).toArrow().to_pylist():
        start = row["block"] * BLOCK
        table[start : start + BLOCK] = np.frombuffer(row["sums"], np.int64).reshape(BLOCK, WIDTH)
    return table


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors, centred and of unit length again; words never seen are zero."""
    seen = sums.any(1)

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    vectors = unit(sums.astype(np.float64))
    if seen.any():
        vectors[seen] -= vectors[seen].mean(0)
    return unit(vectors).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, mean product of neighbours, size."""
    sums, n, pairs = np.zeros((3, WIDTH)), 0, 0
    for words in stretches(text):
        v = vectors[words]
        sums[0] += v.sum(0, dtype=np.float64)
        sums[1] += (v * v).sum(0, dtype=np.float64)
        sums[2] += (v[1:] * v[:-1]).sum(0, dtype=np.float64)
        n, pairs = n + len(v), pairs + max(0, len(v) - 1)
    mean = sums[0] / max(1, n)
    spread = np.sqrt(np.maximum(sums[1] / max(1, n) - mean * mean, 0))
    return np.concatenate([mean, spread, sums[2] / max(1, pairs), [np.log1p(n)]])


# the network


@dataclass(frozen=True)
class Network:
    """Inputs are shifted and scaled; the output is divided by ``temperature``."""

    shift: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.first + self.first_bias) @ self.second + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logits(x) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Network:
    """Train on pooled documents and labels in {0, 1}; every fifth example only sets the temperature."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    positive = float((y.sum() + 1) / (len(y) + 2))
    prior = float(np.log(positive / (1 - positive)))
    shift, scale = np.zeros(FEATURES), np.ones(FEATURES)
    if len(set(y)) < 2:
        return Network(shift, scale, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), prior)
    shift, scale = x[~held].mean(0), x[~held].std(0) + 1e-3
    rng = np.random.default_rng(settings.seed)
    weights = [
        rng.normal(size=(FEATURES, settings.hidden)) / np.sqrt(FEATURES),
        np.zeros(settings.hidden),
        rng.normal(size=settings.hidden) / np.sqrt(settings.hidden),
        np.array([prior]),
    ]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    inputs, truth, step = (x[~held] - shift) / scale, y[~held].astype(float), 0
    for epoch in range(settings.epochs):
        order = rng.permutation(len(truth))
        for at in range(0, len(order), settings.batch):
            some = order[at : at + settings.batch]
            hidden = np.tanh(inputs[some] @ weights[0] + weights[1])
            error = (_logistic(hidden @ weights[2] + weights[3][0]) - truth[some]) / len(some)
            back = np.outer(error, weights[2]) * (1 - hidden * hidden)
            slopes = [inputs[some].T @ back, back.sum(0), hidden.T @ error, np.array([error.sum()])]
            step += 1
            rate = settings.rate * (1 - epoch / settings.epochs)
            for w, slope, (m, s) in zip(weights, slopes, moments):
                m += 0.1 * (slope - m)
                s += 0.001 * (slope * slope - s)
                w -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + settings.decay * w)
    raw = Network(shift, scale, weights[0], weights[1], weights[2], float(weights[3][0]))
    check = held if held.any() else ~held
    z, t = raw.logits(x[check]), y[check]
    choices = np.geomspace(0.2, 10, 200)
    loss = [-np.log(np.where(t == 1, p := _logistic(z / c), 1 - p) + 1e-12).mean() for c in choices]
    return Network(shift, scale, *weights[:3], raw.bias, float(choices[int(np.argmin(loss))]))


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    network: Network
    threshold: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.network.scores(np.stack([pooled(t, self.vectors) for t in texts]))


def labelled_sample(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, settings: Settings) -> DataFrame:
    """At most ``settings.rows`` rows (quality, features) of labelled documents that are not held out."""
    spark = docs.sparkSession
    order = F.xxhash64("id"), F.col("id"), F.col("quality")
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("id")))
        .orderBy(*order)
        .limit(settings.rows)
    )
    sent = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([pooled(t, sent.value) for t in texts])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(wanted), "id")
    # rows that repeat an id may be more than were wanted
    return (
        rows.select("id", "quality", features("text").alias("features"))
        .orderBy(*order, F.xxhash64("features"))
        .limit(settings.rows)
        .select("quality", "features")
    )


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Word vectors from all ``docs`` (doc_id, text), the network from ``labels`` (doc_id, quality)."""
    vectors = word_vectors(context_sums(docs))
    rows = labelled_sample(docs, labels, vectors, settings).toArrow().to_pylist()
    x = np.array([r["features"] for r in rows], float).reshape(len(rows), FEATURES)
    y = np.array([r["quality"] for r in rows], np.int64)
    return Model(vectors, fit(x, y, settings), settings.threshold)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from the threshold on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(list(texts)), dtype=float)

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    found = docs.select(*kept, scored(F.col(f"`{text}`")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))
