"""Token-id files: one long id array cut into blocks, with Elias-Fano coded document boundaries.

``write_tokens`` orders the documents by id over range partitions, encodes them, and
writes blocks as rows of a Parquet table in the shared folder::

    part, block   place of the block: partitions are in ascending order of ids
    n_docs        documents in the block
    doc_ids       their ids, little-endian signed 64-bit integers
    n_ids         ids in the block
    before        ids in the earlier blocks of the same partition
    ids           unsigned 16-bit integers, 32-bit if the vocabulary needs them
    low_bits      width of the low halves of the boundaries
    low, high     Elias-Fano code of the end of each document within the block
    samples       every 256th one of the unary part, for select

The start of a document over all files is the number of ids in all partitions and blocks
before, plus the end of its predecessor in the block: block totals are 64-bit, boundaries take
about 2 + log2(ids per document) bits. A document is never split over blocks.

Defined cases: a null text is empty (only the end id); a null ``doc_id`` sorts first and is
kept; rows of equal ``doc_id`` are ordered by the hash of their text, so repeated rows
follow each other; an empty table writes an empty file; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pareto_frame.llm.common import shuffle_partitions
from pareto_frame.llm.encoder import encoder
from pareto_frame.session import scratch_path

#: A block is closed at this many ids.
BLOCK_IDS = 1 << 20
SAMPLE = 256
SCHEMA = (
    "part int, block int, n_docs long, doc_ids binary, no_id binary, n_ids long, before long, ids binary, wide boolean,"
    " low_bits int, low binary, high binary, samples binary"
)


# Elias-Fano


def ef_encode(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Non-decreasing ``ends``: width of the low halves, low bits, unary high bits, select samples."""
    n = len(ends)
    if n == 0:
        return 0, b"", b"", b""
    ends = ends.astype(np.uint64)
    width = max(0, int(ends[-1] // np.uint64(n)).bit_length() - 1)
    low = ends & np.uint64((1 << width) - 1)
    bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (ends >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    pack = lambda x: np.packbits(x.ravel(), bitorder="little").tobytes()
    return width, pack(bits), pack(high), ones[::SAMPLE].astype("<u4").tobytes()


def ef_select(i: int, width: int, low: bytes, high: bytes, samples: bytes) -> int:
    """The ``i``-th value: counts set bits between two samples, and reads one low half."""
    marks = np.frombuffer(samples, "<u4")
    at = int(marks[i // SAMPLE])
    end = int(marks[i // SAMPLE + 1]) if i // SAMPLE + 1 < len(marks) else 8 * len(high) - 1
    bits = np.unpackbits(np.frombuffer(high[at // 8 : end // 8 + 1], np.uint8), bitorder="little")
    one = at + int(np.flatnonzero(bits[at % 8 :])[i % SAMPLE])
    first = i * width
    near = int.from_bytes(low[first // 8 : (first + width + 7) // 8], "little")
    return ((one - i) << width) | (near >> (first % 8) & ((1 << width) - 1))


def ef_decode(n: int, width: int, low: bytes, high: bytes) -> np.ndarray:
    """All values at once."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little"))[:n]
    value = (ones - np.arange(n)).astype(np.int64) << width
    if width:
        bits = np.unpackbits(np.frombuffer(low, np.uint8), bitorder="little", count=n * width).reshape(n, width)
        value |= bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))
    return value


# writing


def _write(path: str, end_id: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        number, before, held, doc_ids, ends, total = 0, 0, [], [], [], 0
        tail = np.array([end_id], "<u4")

        def block() -> pa.RecordBatch:
            width, low, high, samples = ef_encode(np.array(ends, np.int64))
            ids = np.concatenate(held)
            row = {
                "part": pa.array([part], pa.int32()),
                "block": pa.array([number], pa.int32()),
                "n_docs": pa.array([len(ends)]),
                "doc_ids": pa.array([np.array([d or 0 for d in doc_ids], "<i8").tobytes()]),
                "no_id": pa.array([np.packbits([d is None for d in doc_ids]).tobytes()]),
                "n_ids": pa.array([total]),
                "before": pa.array([before]),
                "ids": pa.array([ids.astype("<u4" if wide else "<u2").tobytes()]),
                "wide": pa.array([wide]),
                "low_bits": pa.array([width], pa.int32()),
                "low": pa.array([low]),
                "high": pa.array([high]),
                "samples": pa.array([samples]),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), list(row))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(encode(text.as_py()), "<u4")
                held += [ids, tail]
                total += len(ids) + 1
                doc_ids.append(doc_id)
                ends.append(total)
                if total >= BLOCK_IDS:
                    yield block()
                    number, before, held, doc_ids, ends, total = number + 1, before + total, [], [], [], 0
        if ends:
            yield block()

    return run


def write_tokens(
    docs: DataFrame, vocabulary: str, end_id: int, text: str = "text", doc_id: str = "doc_id", folder: str | None = None
) -> str:
    """Write the token files of ``docs``; returns their folder."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    wide = max(end_id, *encoder(vocabulary).tokenizer.get_vocab().values()) >= 1 << 16
    (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shuffle_partitions(spark), F.asc_nulls_first("doc_id"), "tie")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
        .select("doc_id", "text")
        .mapInArrow(_write(vocabulary, end_id, wide), SCHEMA)
        .write.parquet(folder)
    )
    return folder


# reading


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            n = row["n_docs"]
            ends = ef_decode(n, row["low_bits"], row["low"], row["high"])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ids = np.frombuffer(row["ids"], "<u4" if row["wide"] else "<u2").astype("<u4")
            missing = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=n).astype(bool)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=missing),
                    pa.array(starts + row["base"] + row["before"]),
                    pa.array(ends - starts),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a folder with ``base``, the number of ids in all partitions before."""
    found = spark.read.schema(SCHEMA).parquet(folder)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the files, a number that a setting bounds: one task, one broadcast
    bases = (
        found.groupBy("part")
        .agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    return found.join(F.broadcast(bases), "part")


def _look_up(wanted: np.ndarray):
    """Rows of the documents in ``wanted`` (sorted ids), each end by ``ef_select``; only their ids are cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                missing = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=row["n_docs"]).astype(bool)
                at = np.flatnonzero(np.isin(doc_ids, wanted) & ~missing)
                code = row["low_bits"], row["low"], row["high"], row["samples"]
                spans = [(ef_select(k - 1, *code) if k else 0, ef_select(k, *code)) for k in at.tolist()]
                size = 4 if row["wide"] else 2
                crc = [
                    zlib.crc32(np.frombuffer(row["ids"][a * size : b * size], f"<u{size}").astype("<u4").tobytes())
                    for a, b in spans
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[at]),
                        pa.array([a + row["base"] + row["before"] for a, _ in spans], pa.int64()),
                        pa.array([b - a for a, b in spans], pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def look_up(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """As ``read_documents``, of the given ids alone (every row of each), without decoding whole blocks."""
    wanted = np.unique(np.array(doc_ids, np.int64))
    return blocks(spark, folder).mapInArrow(
        _look_up(wanted), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return blocks(spark, folder).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
