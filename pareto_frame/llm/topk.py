"""Exact top-k search by distributed selection in score histograms.

Queries and candidates are packed into blocks of vectors. Every query block meets every
candidate block (a stated query set against all rows) in a grid of shuffled cells: a row of cells
reads the same queries, a column the same candidates, and as many of each are taken as copy
both sides alike. Neither side passes through the driver. Each
round scores everything and counts scores per query in ``BINS`` bins of the interval that
still may hold the query's kth score; summing the counts narrows the interval to one
bin, until it is one score wide. A last pass keeps what reaches the kth score, and
ties go to the smaller id. A cell drops only what cannot matter: bins, and at the end
rows, behind ``k`` better ones of the same cell.

Scores are integer inner products of ``floor(scale * x)``.

Defined cases: vectors that are null, hold null or non-finite components, or have a null
id take no part, nor do those whose whole numbers have a squared length of 2^61 or more, since their
scores need not fit a long (all others do, by Cauchy and Schwarz, and so does every partial sum); only vectors of equal length are compared; with fewer than ``k``
candidates all are returned; rows that repeat an id are candidates each, except for the
query of that id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pareto_frame.llm.common import let, shuffle_partitions, stored

BINS = 256
#: Vectors in a block, of queries and of candidates.
QUERY_BLOCK, BLOCK = 1024, 4096
#: Candidates that are scored at once, so that their scores stay in a core's cache.
STRIP = 512
#: Cells of the grid for each shuffle partition: several, as they are dealt by hash; and pairs of blocks that are worth a cell.
CELLS, CELL_PAIRS = 2, 8
#: Whole numbers up to here are exact in these types.
EXACT = {np.float32: 2**24, np.float64: 2**53}
#: Squared lengths from here on make scores, and distances between scores, that a long cannot hold.
LONGEST = 2.0**61


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    doubles = F.col(vector).cast("array<double>")
    times = F.transform(doubles, lambda x: x * F.lit(float(scale)))
    return (
        df.filter(F.col(vec_id).isNotNull() & usable(doubles))
        .select(F.col(vec_id).cast("long").alias("id"), times.alias("x"))
        .filter(_squared("x") < F.lit(LONGEST))
        .select("id", F.transform("x", lambda x: F.floor(x).cast("long")).alias("v"))
        # rounding down may lengthen a vector
        .filter(_squared("v") < F.lit(LONGEST))
    )


def _squared(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def _narrowed(vectors: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them all."""
    least, most = vectors.min(initial=0), vectors.max(initial=0)
    return vectors.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _pack(size: int, with_low: bool):
    """Rows (id, v[, low, above]) of one length to blocks of at most ``size``, in binary."""
    numbers = ["id", "low", "above"] if with_low else ["id"]

    def block(width: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        vectors, ids, *others = columns
        out = [width, ids.tobytes(), _narrowed(vectors).tobytes(), *[x.tobytes() for x in others]]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in out], ["width", "ids", "vectors", *numbers[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each length, the columns of what is no whole block yet
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in numbers]
            vectors = batch.column("v")
            flat, widths = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
            begins = np.cumsum(widths, dtype=np.int64) - widths
            for width in map(int, np.unique(widths)):
                at = np.nonzero(widths == width)[0]
                new = [flat[begins[at][:, None] + np.arange(width)], *[c[at] for c in columns]]
                new = [np.concatenate(x) for x in zip(held[width], new)] if width in held else new
                whole = len(new[0]) // size * size
                for i in range(0, whole, size):
                    yield block(width, [x[i : i + size] for x in new])
                held[width] = [x[whole:] for x in new]
        for width, rest in held.items():
            if len(rest[0]):
                yield block(width, rest)

    return run


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where that is exact, else in integers."""
    # the absolute value of the least number may not fit its type
    most = queries.shape[1]
    for x in (queries, rows):
        most *= max(-float(x.min(initial=0)), float(x.max(initial=0)))
    kind = next((t for t, exact in EXACT.items() if most < exact), np.int64)
    return queries.astype(kind) @ rows.astype(kind).T


def _reaching(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score where the score is at least the query's ``least``."""
    if bound := EXACT.get(scores.dtype.type):
        # scores stay below the bound, so a limit cut to it says the same
        least = np.clip(least, -bound, bound).astype(scores.dtype)
    at = np.flatnonzero(scores >= least[:, None])
    q, c = np.divmod(at, scores.shape[1])
    return q, c, scores.ravel()[at].astype(np.int64)


def _blocks_of(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = np.frombuffer(row[f"{side}_ids"], np.int64), row[f"{side}_vectors"]
    numbers = max(1, len(ids) * row["width"])
    kind = f"i{max(1, len(vectors) // numbers)}"
    return ids, np.frombuffer(vectors, kind).reshape(len(ids), row["width"])


class _Histograms:
    """Of each query, counts of the scores in its interval of ``width``, from the best bins on as far as k scores."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, above: np.ndarray, width: int, step: int, k: int):
        self.ids, self.low, self.above, self.width, self.step, self.k = ids, low, above, width, step, k
        self.counts = np.zeros((len(ids), BINS), np.int64)
        #: no lower score can be the kth best
        self.bound, self.new = low.copy(), 0

    def add(self, scores: np.ndarray, others: np.ndarray) -> None:
        q, c, s = _reaching(scores, self.bound)
        height = s - self.low[q]
        # what lies above the interval has been counted before
        inside = (height < self.width) & (others[c] != self.ids[q])
        at = q[inside] * BINS + height[inside] // self.step
        np.add.at(self.counts.reshape(-1), at, 1)
        self.new += len(at)
        if self.new >= self.k * len(self.ids):
            self.new = 0
            reached = (self._better() + self.counts + self.above[:, None] >= self.k).sum(1)
            self.bound = np.maximum(self.bound, self.low + np.maximum(reached - 1, 0) * self.step)

    def _better(self) -> np.ndarray:
        return self.counts[:, ::-1].cumsum(1)[:, ::-1] - self.counts

    def found(self) -> pa.RecordBatch:
        q, b = np.nonzero((self.counts > 0) & (self._better() + self.above[:, None] < self.k))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[q]), pa.array(b.astype(np.int64)), pa.array(self.counts[q, b])], ["id", "bin", "n"]
        )


class _Best:
    """Of each query, the best k of the rows of at least its ``low``."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, above: np.ndarray, k: int):
        self.ids, self.low, self.k = ids, low, k
        self.kept = [np.zeros(0, np.int64)] * 3
        self.new: list[tuple] = []

    def add(self, scores: np.ndarray, others: np.ndarray) -> None:
        q, c, s = _reaching(scores, self.low)
        other = others[c] != self.ids[q]
        self.new.append((q[other], others[c[other]], s[other]))
        if sum(len(x[0]) for x in self.new) >= self.k * len(self.ids):
            self._cut()

    def _cut(self) -> None:
        q, c, s = [np.concatenate(x) for x in zip(self.kept, *self.new)]
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.kept, self.new = [q[keep], c[keep], s[keep]], []

    def found(self) -> pa.RecordBatch:
        self._cut()
        q, c, s = self.kept
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(c), pa.array(s)], ["id", "other", "score"])


def _meet(kind: type, *settings: int):
    """What ``kind`` finds of each query block in the candidate blocks that follow each other beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if row["q_ids"] != last:
                    if held:
                        yield held.found()
                    last = row["q_ids"]
                    ids, queries = _blocks_of(row, "q")
                    held = kind(ids, *[np.frombuffer(row[n], np.int64) for n in ("q_low", "q_above")], *settings)
                others, rows = _blocks_of(row, "c")
                for j in range(0, len(others), STRIP):
                    held.add(_scores(queries, rows[j : j + STRIP]), others[j : j + STRIP])
        if held:
            yield held.found()

    return run


def _grid(partitions: int, queries: int, rows: int, query_blocks: int, blocks: int) -> tuple[int, int]:
    """Parts of the query blocks and of the candidate blocks: cells enough for all partitions, copying both sides alike."""
    cells = max(1, min(CELLS * partitions, query_blocks * blocks // CELL_PAIRS))
    parts = min(blocks, math.ceil(math.sqrt(cells * rows / queries)))
    query_parts = min(query_blocks, math.ceil(cells / parts))
    return query_parts, min(blocks, math.ceil(cells / query_parts))


def top_k(
    df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64
) -> DataFrame:
    """For each row for which ``is_query`` holds: query_id, rank, vec_id, score of its ``k`` best others."""
    spark = df.sparkSession
    block = "width long, ids binary, vectors binary"
    rows = whole_vectors(df, vec_id, vector, scale)
    queries = stored(whole_vectors(df.filter(is_query), vec_id, vector, scale), "topk-queries")
    # lengths and the largest norm bound every score
    all_rows = rows.agg(F.max(_squared("v")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    # the bound is a sum of doubles
    reach = int((all_rows["m"] or 0) * (1 + 1e-9)) + 2
    salt = F.monotonically_increasing_id()
    candidates = stored(rows.mapInArrow(_pack(BLOCK, False), block).withColumn("salt", salt), "topk-blocks")
    query_blocks = max(1, -(-queries.count // QUERY_BLOCK))

    # ids that repeat among the queries are one query
    state = queries.rows.dropDuplicates(["id"]).select(
        "id", "v", F.lit(-reach).cast("long").alias("low"), F.lit(0).cast("long").alias("above")
    )

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("salt"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def met(asked: DataFrame) -> DataFrame:
        """Each query block beside each candidate block."""
        packed = asked.coalesce(query_blocks).mapInArrow(_pack(QUERY_BLOCK, True), f"{block}, low binary, above binary")
        q = stored(packed.withColumn("salt", salt), "topk-asked")
        sizes = [max(1, n) for n in (queries.count, all_rows["n"], q.count, candidates.count)]
        query_parts, parts = _grid(shuffle_partitions(spark), *sizes)
        asked_cells = q.rows.select(
            "width",
            *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "low", "above")],
            part(query_parts).alias("q_part"),
            every(parts).alias("c_part"),
        )
        cells_of = candidates.rows.select(
            "width",
            F.col("ids").alias("c_ids"),
            F.col("vectors").alias("c_vectors"),
            part(parts).alias("c_part"),
            every(query_parts).alias("q_part"),
        )
        # Spark takes the copies for as small as the packed file they come from and would broadcast them
        return asked_cells.hint("merge").join(cells_of, ["width", "q_part", "c_part"]).drop("q_part", "c_part")

    width = 2 * reach + 1
    while width > 1:
        step = -(-width // BINS)
        counts = met(state).mapInArrow(_meet(_Histograms, width, step, k), "id long, bin long, n long")
        counts = counts.groupBy("id", "bin").agg(F.sum("n").alias("n"))
        # per query there are at most BINS bins
        found = counts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
        start = F.struct(F.lit(-1).cast("long").alias("bin"), F.col("above").alias("above"), F.lit(False).alias("done"))
        chosen = F.aggregate(
            "bins",
            start,
            lambda a, x: F.when(a["done"], a).otherwise(
                F.struct(
                    x["bin"].alias("bin"),
                    F.when(a["above"] + x["n"] >= k, a["above"]).otherwise(a["above"] + x["n"]).alias("above"),
                    (a["above"] + x["n"] >= k).alias("done"),
                )
            ),
        )
        narrowed = state.join(found, "id", "left").select(
            "id", "v", "low", "above", F.when(F.col("bins").isNotNull(), let(chosen, lambda c: c)).alias("c")
        )
        # fewer than k scores in all: the low end stays, and everything is returned
        state = stored(
            narrowed.select(
                "id",
                "v",
                F.when(F.col("c.done"), F.col("low") + F.col("c.bin") * step).otherwise(F.col("low")).alias("low"),
                F.when(F.col("c.done"), F.col("c.above")).otherwise(F.col("above")).alias("above"),
            ),
            "topk-state",
        ).rows
        width = step
    best = met(state).mapInArrow(_meet(_Best, k), "id long, other long, score long")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score")
    )
