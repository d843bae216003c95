"""Whitening of embeddings with MLlib's distributed block matrices.

1. Vectors become whole numbers ``x = floor(scale * c) + shift``; their number, and the exact sum
   of each dimension, come from one aggregation.
2. ``n * x - S`` is computed in whole numbers, so centring is exact to the last bit of a double. Centred
   rows get consecutive indices (a count per stored partition) and become an
   ``IndexedRowMatrix``, then a ``BlockMatrix`` of ``BLOCK_ROWS`` rows a block.
3. The scatter matrix is the product of the transposed blocks with the blocks, its middle dimension
   split over tasks of ``BLOCKS_A_TASK`` blocks; the partial products, one square of the dimension
   each, are added up. Its eigenvectors are found locally with ``numpy.linalg.eigh``.
4. The blocks times the whitening matrix (eigenvectors over square roots of eigenvalues) are the
   whitened rows; they are written, centred again and multiplied in the same way to measure how far
   their covariance is from the identity.

Only counts and matrices of the size of the dimension reach the driver.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, and
neither do those with an entry that, scaled, is not below 2^62 (no whole number of 64 bits); of vectors of different
lengths those of the commonest length are used, the longest of them if equally common; repeated rows and null or repeated ids
are rows of their own; ``deviation`` is null where it exceeds a long. Dimensions
without variance, as in a table of one row or of equal rows, give components of eigenvalue 0: ``whitened``
and ``explained`` are 0 there, and ``identity_error`` leaves them out. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pareto_frame.llm.common import Stored, stored
from pareto_frame.llm.topk import usable

BLOCK_ROWS = 1024
BLOCK_COLUMNS = 1024
BLOCKS_A_TASK = 16
#: Eigenvalues up to this share of the largest one are rounding errors of zero.
NOTHING = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What is learned: rows, sums, eigenvalues falling, eigenvectors as columns, their trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def matrix(self) -> np.ndarray:
        """Centred rows times this are whitened; columns without variance are zero."""
        there = self.values > 0
        return np.where(there, self.vectors / np.sqrt(np.where(there, self.values, 1.0)), 0.0)


def whole_rows(df: DataFrame, vec_id: str, vector: str, scale: float, shift: int) -> Stored:
    """vec_id, x (whole numbers) of the rows that take part, with ``part`` and ``place`` of each, stored."""
    doubles = F.col(vector).cast("array<double>")
    fits = F.forall("c", lambda c: F.abs(c * F.lit(float(scale))) < F.lit(2.0**62))
    rows = (
        df.filter(usable(doubles) & (F.size(doubles) > 0))
        .select(F.col(vec_id).alias("vec_id"), doubles.alias("c"))
        .filter(fits)
        .select(
            "vec_id",
            F.transform("c", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift)).alias("x"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        )
    )
    whole = stored(rows, "whole")
    sizes = whole.rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d"))
    found = sizes.take(2)
    if len(found) < 2:
        return whole
    # indices have to be consecutive among the rows that take part
    chosen = whole.rows.filter(F.size("x") == found[0]["d"])
    again = chosen.select(
        "vec_id",
        "x",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
    return stored(again, "whole")


def indexed(rows: DataFrame) -> DataFrame:
    """``index`` from 0 without a gap; one row per stored partition passes one task."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return rows.join(F.broadcast(before), "part").withColumn("index", F.col("before") + F.col("place")).drop("before")


def exact_sums(rows: DataFrame) -> list[int]:
    """The sum of each dimension, exact for any number of rows."""
    found = (
        rows.select(F.posexplode("x").alias("i", "x"))
        .groupBy("i")
        .agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
        .toArrow()
        .to_pylist()
    )
    return [int(r["s"]) for r in sorted(found, key=lambda r: r["i"])]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def deviations(x: Column, n: int, sums: list[int]) -> tuple[Column, Column]:
    """Of a row of whole numbers: the centred row, and the sum of (n * x - S)^2, null if beyond a long.

    With S = n * q + r, n * x - S is n * (x - q) - r.
    """
    whole, rest = _longs([s // n for s in sums]), [s % n for s in sums]
    apart = F.zip_with(x, whole, lambda a, q: a - q)
    centred = F.zip_with(apart, F.array(*[F.lit(r / n) for r in rest]), lambda a, f: a.cast("double") - f)
    each = F.zip_with(apart, _longs(rest), lambda a, r: F.try_subtract(F.try_multiply(a, F.lit(n).cast("long")), r))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda t, y: F.try_add(t, F.try_multiply(y, y)))
    return centred, total


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Rows (index, values array<double>) as distributed blocks."""
    vectors = rows.select(F.col("index").cast("long"), array_to_vector("values").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width)
    return matrix.toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transposed blocks times blocks, symmetric.

    The Python method has no argument for the split of the middle dimension, without which one task
    would get all rows, so the JVM's is called.
    """
    splits = max(1, -(-blocks.numRows() // (BLOCK_ROWS * BLOCKS_A_TASK)))
    wrapped = blocks.transpose()._java_matrix_wrapper
    product = wrapped.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    found = BlockMatrix(product, BLOCK_COLUMNS, BLOCK_COLUMNS).toLocalMatrix().toArray()
    return (found + found.T) / 2


def multiply(blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """index, values: rows of the blocks times a local matrix of at most the dimension squared."""
    spark_context = blocks.blocks.context
    height, width = matrix.shape
    parts = [
        (
            (i // BLOCK_COLUMNS, j // BLOCK_COLUMNS),
            DenseMatrix(*part.shape, part.ravel(order="F")),
        )
        for i in range(0, height, BLOCK_COLUMNS)
        for j in range(0, width, BLOCK_COLUMNS)
        for part in [matrix[i : i + BLOCK_COLUMNS, j : j + BLOCK_COLUMNS]]
    ]
    right = BlockMatrix(spark_context.parallelize(parts, 1), BLOCK_COLUMNS, BLOCK_COLUMNS, height, width)
    product = blocks.multiply(right).toIndexedRowMatrix()
    # rows as the JVM holds them; the attribute ``rows`` would send each through Python
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def learn(blocks: BlockMatrix, n: int, sums: list[int]) -> Whitening:
    covariance = scatter(blocks) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    values = np.where(values > NOTHING * max(values[0], 0.0), values, 0.0)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def whiten(
    df: DataFrame,
    components: int = 32,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64,
    shift: int = 1_000_000,
) -> tuple[DataFrame, Whitening | None, float]:
    """vec_id, deviation, whitened (array of up to ``components``); what was learned; the error of the identity."""
    whole = whole_rows(df, vec_id, vector, scale, shift)
    if not whole.count:
        empty = whole.rows.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened"))
        return empty, None, 0.0
    # of several lengths one is left, so the rows are counted here
    n = whole.count
    sums = exact_sums(whole.rows)
    centred, deviation = deviations(F.col("x"), n, sums)
    rows = indexed(whole.rows)
    blocks = block_matrix(rows.select("index", centred.alias("values")), n, len(sums))
    model = learn(blocks, n, sums)
    k = min(components, len(sums))
    projected = stored(multiply(blocks, model.matrix()[:, :k]), "whitened").rows
    error = identity_error(projected, n, k, model)
    named = rows.select("index", "vec_id", deviation.alias("deviation"))
    out = named.join(projected, "index").select("vec_id", "deviation", F.col("values").alias("whitened"))
    return out, model, error


def identity_error(projected: DataFrame, n: int, k: int, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    there = np.flatnonzero(model.values[:k] > 0)
    if not len(there):
        return 0.0
    means = projected.select(F.posexplode("values").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    found = sorted(means.toArrow().to_pylist(), key=lambda r: r["i"])
    mean = F.array(*[F.lit(float(r["m"])) for r in found])
    again = projected.select("index", F.zip_with("values", mean, lambda v, m: v - m).alias("values"))
    covariance = scatter(block_matrix(again, n, k)) / n
    return float(np.abs(covariance - np.eye(k))[np.ix_(there, there)].max())


def components_of(df: DataFrame, components: int = 32, **settings) -> DataFrame:
    """One row per vector and component, numbered from 1 by falling eigenvalue."""
    rows, model, error = whiten(df, components, **settings)
    n, shares = 0, [0.0]
    if model is not None:
        n, shares = model.n, [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]
    explained = F.array(*[F.lit(s) for s in shares])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
