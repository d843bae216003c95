"""Vector best-fit packing of documents into sequences.

Every document becomes ids and an end id. Only documents longer than a sequence are cut,
into whole sequences from their end, so their first piece may be shorter. The pieces
are packed by best-fit in order of falling length. A sequence has three capacities:
tokens, documents, and attention cost (the sum of squared lengths); a piece of length
``l`` demands ``(l, 1, l * l)``. Among the sequences with room under every capacity, the
best has the largest dot product of demand and residual, each as a share of its
capacity and weighted, or the smallest norm of what would be left.

A piece's demand depends on its length alone. So the plan is made from the number of
pieces of each length, at most ``tokens`` numbers whatever the input: sequences of equal
content are one entry of the plan, and one step places equal pieces, one each, into the
sequences of the best entry. Spark then numbers the pieces of each length, and looks up
the sequence and offset of each number.

Defined cases: a null text is empty and makes a piece of the end id alone; null and
repeated ``doc_id`` are packed row by row; an empty table gives an empty result; further
columns are ignored. The numbering of equal lengths goes by hashed buckets, so no length
overloads a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pareto_frame.llm.common import stored
from pareto_frame.llm.encoder import encoder

#: Pieces are numbered within this many buckets for each length.
BUCKETS = 128


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and how best-fit weighs it.

    The defaults for documents and attention cost are implied by the tokens: they bind only
    if they are lowered. ``rule`` is ``dot`` or ``norm``.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


def plan(counts: np.ndarray, capacity: Capacity) -> np.ndarray:
    """Rows (length, first number, end number, first sequence, offset), from ``counts[length]``.

    The pieces of one length are numbered from 0; those from the first number on go, one each,
    to the sequences from the first sequence on.
    """
    limits, weights = capacity.limits(), np.array(capacity.weights)
    if limits[1] < 1 or limits[2] < limits[0] ** 2:
        raise ValueError("a piece of full length has to fit into a sequence")
    left = np.zeros((0, 3), np.int64)  # residual capacities of a run of equal sequences
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in range(len(counts) - 1, 0, -1):
        number, rest = 0, int(counts[length])
        demand = np.array([length, 1, length * length], np.int64)
        each = int((limits // demand).min())
        while rest:
            fits = np.flatnonzero((left >= demand).all(1))
            if len(fits):
                after, share = (left[fits] - demand) / limits, demand / limits
                if capacity.rule == "dot":
                    score = -((left[fits] / limits) * share) @ weights
                else:
                    score = (after * after) @ weights
                run = fits[np.lexsort((first[fits], score))[0]]
                placed = min(rest, int(many[run]))
                out.append((length, number, number + placed, int(first[run]), int(limits[0] - left[run, 0])))
                if placed < many[run]:  # the others of the run keep their state
                    left = np.vstack([left, left[run]])
                    first, many = np.append(first, first[run] + placed), np.append(many, many[run] - placed)
                    many[run] = placed
                left[run] -= demand
            else:
                # new sequences, as many as the rest fills; they get one piece each now
                placed = min(rest, -(-rest // each))
                out.append((length, number, number + placed, sequences, 0))
                left = np.vstack([left, limits - demand])
                first, many = np.append(first, sequences), np.append(many, placed)
                sequences += placed
            number, rest = number + placed, rest - placed
        keep = left[:, 0] > 0
        left, first, many = left[keep], first[keep], many[keep]
    return np.array(out, np.int64).reshape(-1, 5)


def _pieces(vocabulary: str, end_id: int, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + tail
                n, start = len(ids) // 4, 0
                end = n % tokens or tokens
                piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    piece, start, end = piece + 1, end, end + tokens
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def cut(
    docs: DataFrame, vocabulary: str, end_id: int = 0, tokens: int = 2048, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(
        _pieces(vocabulary, end_id, tokens), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _place(table: np.ndarray):
    """Looks up each piece's sequence and offset in the plan."""
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    lengths, numbers = table[:, 0], table[:, 1]
    begin = np.searchsorted(lengths, np.arange(lengths.max(initial=0) + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            row = np.empty(len(length), np.int64)
            for one in np.unique(length):
                mine = length == one
                a, b = begin[one], begin[one + 1]
                row[mine] = a + np.searchsorted(numbers[a:b], number[mine], "right") - 1
            sequence = table[row, 3] + number - table[row, 1]
            names = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(table[row, 4])],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (see :func:`cut`) with ``sequence_id`` and ``offset``."""
    kept = stored(
        pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")),
        "pieces",
    ).rows
    # at most tokens * BUCKETS rows, whatever the input
    sizes = kept.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(
        sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-sizes"
    ).rows
    counts = np.zeros(capacity.tokens + 1, np.int64)
    told = sizes.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most a row per length
    counts[told["length"].to_numpy()] = told["n"].to_numpy()
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        kept.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(sizes.select("length", "bucket", "before")), ["length", "bucket"])
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("number")
        )
    )
    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return numbered.mapInArrow(_place(plan(counts, capacity)), schema)
