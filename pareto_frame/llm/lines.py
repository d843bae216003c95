"""Line dedup by a deletion-neighbourhood join.

Lines are what stands between line feeds. A line is removed if an equal line stands
earlier, by ``doc_id``, then line number. A line of at least ``min_chars`` characters is also
removed if an earlier line of at least ``min_chars`` is within one edit (a character replaced, inserted or
deleted). Earlier lines count whether or not they are removed themselves, so the result
does not depend on any order of work. Blank lines stay.

Lines within one edit of each other share all of one half: with ``m`` the length of the
shorter one, the first ``m / 2`` characters or the rest. So hashes of halves leave only lines
that share a half with another line, losing no pair. Of these, all variants with one
character deleted in the other half are emitted as hashed keys:

* two lines that differ in the character at one place share the variant and the place;
* a line with one character more has the other line itself among its variants.

In the first kind all lines of a key are within one edit, in the second a key joins one
line with all longer ones. So the earliest line of each side of a key stands for it, and no
pairs within a key are needed. A pair that comes from equal keys is verified by its
edit distance before a line goes.

Defined cases: a null text stays null, an empty one empty; a null ``doc_id`` comes first;
rows of equal ``doc_id`` are one document: their lines of one number are the same place, so
repeated rows stay alike; lines of any length are whole (the variants of a line cost time
in proportion to its length); an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pareto_frame.llm.common import let, maybe_broadcast, stored

MIN_CHARS = 20
#: Kinds of variant keys.
REPLACED, SHORTER, ITSELF = 0, 1, 2

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def variant_keys(line: str, left: bool, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and kinds of a line's variants, deleting in the halves asked for, and of the line itself.

    The hash is a polynomial over the characters, so that of each variant follows from running
    sums, and a line's keys take time in proportion to its length.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    power = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, _BASE)]), dtype=U)
    sums = np.concatenate([[U(0)], np.cumsum(_mix(codes.astype(U) + _BASE) * power, dtype=U)])
    at = np.arange(n)
    # an edit in the half after a shared first half, or before a shared second half of either length
    at = at[(right & (at >= (n - 1) // 2)) | (left & (at <= n // 2))]
    shorter = sums[at] + (sums[n] - sums[at + 1]) * _BACK
    size = U(n * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    replaced = _mix(_mix(shorter + size) + at.astype(U) * _BASE + U(1))
    less = np.unique(_mix(shorter + size - U(0xD6E8FEB86659FD93)))
    itself = _mix(sums[n : n + 1] + size)
    keys = np.concatenate([replaced, less, itself]).view(np.int64)
    kinds = np.repeat([REPLACED, SHORTER, ITSELF], [len(replaced), len(less), 1]).astype(np.int32)
    return keys, kinds


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one, line, left, right in zip(
            batch.column("h1").to_pylist(), batch.column("line"), batch.column("left").to_pylist(), batch.column("right").to_pylist()
        ):
            keys, kinds = variant_keys(line.as_py(), left, right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(kinds), pa.array(np.full(len(keys), one))], ["key", "kind", "h1"]
            )


def _half_keys(line: Column, n: Column) -> Column:
    """For the line as the shorter or equal one of a pair, and as the longer one: both halves."""
    found = []
    for m in (n, n - 1):
        first = F.floor(m / 2).cast("int")
        for side, part in (("p", F.substring(line, F.lit(1), first)), ("s", F.substring(line, n - (m - first) + 1, m - first))):
            found.append(F.struct(F.xxhash64(F.lit(side), m, part).alias("key"), F.lit(side == "p").alias("first")))
    return F.array(*found)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, line_no, h1, h2, halves) of every line that is not blank."""
    long = F.length("line") >= min_chars
    return (
        docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .filter(F.trim(F.col("line")) != "")
        .select(
            "doc_id",
            "line_no",
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit(1), "line").alias("h2"),
            F.when(long, _half_keys(F.col("line"), F.length("line"))).alias("halves"),
        )
    )


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, near) of the lines of (doc_id, text) to remove."""
    lines = stored(_lines(docs, min_chars), "lines").rows
    place = F.struct("doc_id", "line_no")

    repeated = stored(
        lines.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("earliest"))
        .filter("n > 1")
        .drop("n"),
        "repeated",
    )
    exact = lines.join(maybe_broadcast(repeated), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("earliest")))

    near = lines.join(maybe_broadcast(_near(lines, docs)), ["h1", "h2"])
    # a line that is removed as an exact copy is told as such
    return (
        exact.select("doc_id", "line_no", F.lit(False).alias("near"))
        .unionByName(near.select("doc_id", "line_no", F.lit(True).alias("near")))
        .groupBy("doc_id", "line_no")
        .agg(F.min("near").alias("near"))
    )


def _near(lines: DataFrame, docs: DataFrame):
    """Stored (h1, h2) of the lines that have an earlier one within one edit."""
    halves = lines.select("h1", "h2", "doc_id", "line_no", F.explode("halves").alias("half")).select(
        "h1", "h2", "doc_id", "line_no", "half.*"
    )
    shared = stored(
        halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key"),
        "halves",
    )
    rivals = (
        halves.join(maybe_broadcast(shared), "key")
        .groupBy("h1", "h2")
        .agg(
            F.min(F.struct("doc_id", "line_no")).alias("place"),
            F.max(~F.col("first")).alias("left"),
            F.max("first").alias("right"),
        )
    )
    wanted = stored(
        rivals.groupBy(F.col("place.doc_id").alias("of")).agg(
            F.collect_list(F.struct("h1", "h2", "left", "right", "place")).alias("wanted")
        ),
        "wanted",
    )
    texts = docs.join(maybe_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("of"))).select(
        F.explode(
            let(
                F.struct(F.split("text", "\n", -1).alias("lines"), F.col("wanted").alias("wanted")),
                lambda v: F.transform(
                    v["wanted"], lambda w: F.struct(w.alias("w"), F.get(v["lines"], w["place"]["line_no"]).alias("line"))
                ),
            )
        ).alias("x")
    )
    rivals = stored(
        texts.select("x.w.*", "x.line").filter(F.xxhash64("line") == F.col("h1")).dropDuplicates(["h1", "h2"]), "rivals"
    ).rows
    variants = rivals.select("h1", "line", "left", "right").mapInArrow(_variants, "key long, kind int, h1 long")
    equal = stored(
        variants.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key"),
        "variants",
    )
    met = stored(
        variants.join(maybe_broadcast(equal), "key").join(rivals.select("h1", "place"), "h1"), "met"
    ).rows
    of_kind = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("place", "h1")))
    best = met.groupBy("key").agg(
        of_kind(REPLACED).alias("replaced"), of_kind(SHORTER).alias("longer"), of_kind(ITSELF).alias("shorter")
    )
    rival = (
        F.when(F.col("kind") == REPLACED, F.col("replaced"))
        .when(F.col("kind") == SHORTER, F.col("shorter"))
        .otherwise(F.col("longer"))
    )
    pairs = (
        met.join(best, "key")
        .withColumn("rival", rival)
        .filter(F.col("rival.place") < F.col("place"))
        .select("h1", F.col("rival.h1").alias("other"))
        .distinct()
    )
    theirs = rivals.select(F.col("h1").alias("other"), F.col("line").alias("other_line"))
    verified = (
        pairs.join(rivals.select("h1", "h2", "line"), "h1")
        .join(theirs, "other")
        .filter(F.levenshtein("line", "other_line", 1) >= 0)
    )
    return stored(verified.select("h1", "h2").distinct(), "near")


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with their lines deduplicated in ``text``, and ``removed``: array<struct<line_no, near>>."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gone = (
        removed_lines(narrow, min_chars)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "near"))).alias("__removed"))
    )
    # both sides grow with the documents, so the join is shuffled at every size
    joined = docs.join(gone.hint("merge"), F.col(doc_id).eqNullSafe(F.col("__id")), "left")
    cleaned = let(
        F.struct(F.split(F.col(text), "\n", -1).alias("lines"), F.col("__removed.line_no").alias("gone")),
        lambda v: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(v["lines"]) - 1), v["gone"]), lambda i: F.get(v["lines"], i)
            ),
            "\n",
        ),
    )
    new_text = F.when(F.col("__removed").isNull(), F.col(text)).otherwise(cleaned)
    empty = F.array().cast("array<struct<line_no:int,near:boolean>>")
    kept = [new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "removed"]
    return joined.select(*kept, F.coalesce("__removed", empty).alias("removed"))
