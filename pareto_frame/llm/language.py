"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its letters and the stretches of 2 to 4 characters of its words,
with word ends marked; all are hashed into ``BUCKETS`` rows of an embedding table. The
mean of their rows goes through one linear layer and a softmax. Embeddings and layer are
trained together by stochastic gradient descent in numpy, one example at a time, on a
bounded sample: at most ``rows`` labelled documents in all, spread evenly over languages,
the ones of smallest hashed id. Each gives three examples: the whole text, and two
stretches of a few words.

Part of the sample is held back to calibrate: a temperature makes the largest probability
a calibrated confidence, and the rejection threshold is the largest confidence that
``keep`` of the calibration examples reach; there is no fixed bound, since the least possible
confidence depends on the number of languages. With one language confidence is always 1, so
only texts without a letter are rejected.

Since the layer is linear, a subword's share of the logits is looked up as one row
(embedding times layer), so prediction is one gather over the whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected;
rows with null language or null id are never trained on; without any training row
everything is ``und``; texts are read whole, in stretches of ``STRETCH`` characters that
no subword crosses; repeated rows are predicted alike; further columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, WIDTH = 1 << 15, 16
STRETCH = 1 << 20
NONE = "und"


@dataclass(frozen=True)
class Settings:
    rows: int = 2400
    epochs: int = 5
    rate: float = 0.5
    keep: float = 0.999
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``logits``: for each bucket its part of the logits; confidence is softmax(logits * sharpness)."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    sharpness: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float]:
        buckets = subwords(text)
        if not self.languages or not len(buckets):
            return NONE, 0.0
        p = softmax((self.logits[buckets].mean(0) + self.bias) * self.sharpness)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def subwords(text: str | None) -> np.ndarray:
    """Buckets of all subwords of a text, repeated as often as they occur."""
    if not text:
        return np.zeros(0, np.int64)
    found = [_stretch(text[i : i + STRETCH]) for i in range(0, len(text), STRETCH)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def _stretch(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where(_letters()[codes], codes, 0)
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one mark between words
    inner = codes != 0
    found, h, ok = [], codes.copy(), inner
    found.append(_bucket(h[inner]))
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        # marks only at the ends, and not nothing but marks
        ok = np.ones(len(h), bool) if n == 2 else ok[:-1] & inner[n - 2 : len(codes) - 1]
        keep = ok & (inner[: len(h)] | inner[n - 1 :]) if n == 2 else ok
        found.append(_bucket(h[keep] + np.uint64(n)))
    return np.concatenate(found)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def examples(text: str, number: int) -> list[bytes]:
    """The whole text and two stretches of words, at a place given by ``number``; see ``packed``."""
    words = text.split()
    out = [subwords(text)]
    for size in (24, 5):
        start = number % max(1, len(words) - size + 1)
        out.append(subwords(" ".join(words[start : start + size])))
    return [packed(x) for x in out if len(x)]


def packed(buckets: np.ndarray) -> bytes:
    """The distinct buckets in 16 bits each, then how often each occurs in 32."""
    distinct, counts = np.unique(buckets, return_counts=True)
    return distinct.astype("<u2").tobytes() + counts.astype("<u4").tobytes()


def unpacked(example: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and the share of each."""
    n = len(example) // 6
    counts = np.frombuffer(example, "<u4", offset=2 * n).astype(np.float32)
    return np.frombuffer(example, "<u2", count=n).astype(np.int32), counts / counts.sum()


def fit(docs: list[tuple[int, str, list[bytes]]], settings: Settings) -> Model:
    """Train on (hashed id, language, packed examples)."""
    languages = sorted({language for _, language, _ in docs})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    docs = sorted(docs, key=lambda d: d[0])
    number = {language: i for i, language in enumerate(languages)}
    rows = [
        (i % 5 == 4, number[language], *unpacked(x)) for i, (_, language, found) in enumerate(docs) for x in found
    ]
    train = [r for r in rows if not r[0]] or rows
    check = [r for r in rows if r[0]] or rows
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    seen = np.zeros(BUCKETS, bool)
    for row in train:
        seen[row[2]] = True
    table[~seen] = 0  # unknown subwords say nothing, so they lower the confidence
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps, done = settings.epochs * len(train), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(train)):
            _, language, buckets, share = train[i]
            rate = settings.rate * (1 - done / steps)
            mean = share @ table[buckets]
            error = softmax(mean @ layer + bias)
            error[language] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * error
            # rows get their share of the gradient, scaled up as a row is seen rarely
            table[buckets] -= (rate * len(buckets)) * np.minimum(share, 4 / len(buckets))[:, None] * back / np.sqrt(len(buckets))
            done += 1
    logits = table @ layer
    raw = np.array([share @ logits[buckets] + bias for _, _, buckets, share in check])
    truth = np.array([language for _, language, _, _ in check])
    scales = np.geomspace(0.05, 20, 120)
    loss = [-np.log(softmax(raw * s)[np.arange(len(truth)), truth] + 1e-12).mean() for s in scales]
    sharpness = float(scales[int(np.argmin(loss))])
    sure = np.sort(softmax(raw * sharpness).max(1))
    threshold = float(sure[int((1 - settings.keep) * len(sure))])
    return Model(languages, logits.astype(np.float32), bias, sharpness, threshold)


def training_sample(docs: DataFrame, settings: Settings, text: str, language: str, doc_id: str) -> DataFrame:
    """At most ``settings.rows`` rows (number, language, examples), as many of each language."""
    usable = docs.filter(
        F.col(text).isNotNull() & F.col(language).isNotNull() & F.col(doc_id).isNotNull()
    ).select(
        F.col(doc_id).cast("string").alias("id"),
        F.xxhash64(F.col(doc_id).cast("string")).alias("number"),
        F.col(language).alias("language"),
        F.col(text).alias("text"),
    )
    narrow = usable.select("number", "language")
    sizes = narrow.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    languages = max(1, sizes.count())
    each = max(1, settings.rows // languages)
    # hashed ids spread evenly, so a share of their range leaves about twice the rows wanted
    # of each language, however many there are; the ranks are taken among those
    share = (F.col("number").cast("double") / 2.0**64 + 0.5) * F.col("n") <= 2.0 * each + 50
    rank = F.row_number().over(Window.partitionBy("language").orderBy("number"))
    limits = (
        narrow.join(F.broadcast(sizes.limit(settings.rows)), "language")
        .filter(share)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= each)
        .groupBy("language")
        .agg(F.max("number").alias("most"))
    )
    chosen = usable.join(F.broadcast(limits), "language").filter(F.col("number") <= F.col("most"))

    @F.pandas_udf("array<binary>")
    def found(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([examples(t, n) for t, n in zip(texts, numbers)])

    return chosen.select("number", "language", found("text", "number").alias("examples"))


def held_out(doc_id: Column) -> Column:
    """Whether the contract keeps a document from training; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    settings: Settings = Settings(),
    text: str = "text",
    language: str = "lang",
    doc_id: str = "doc_id",
) -> Model:
    """Learn from the documents that are not held out."""
    sample = training_sample(docs.filter(~held_out(F.col(doc_id))), settings, text, language, doc_id)
    rows = sample.toArrow().to_pylist()
    return fit([(row["number"], row["language"], row["examples"]) for row in rows], settings)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return (
        docs.select(*kept, guess(F.col(text)).alias("__guess"))
        .select(*kept, F.col("__guess.lang_pred"), F.col("__guess.score"))
        .withColumn("rejected", (F.col("lang_pred") == NONE) | (F.col("score") < model.threshold))
    )
