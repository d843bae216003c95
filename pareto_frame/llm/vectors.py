"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, learned independently for the two halves of the vectors, span a grid of
cells; every vector lies in the cell of its nearest codewords. A vector visits the
cells in the order of their distance, the sum of the two halves' distances, which a
multi-sequence traversal (a heap that grows from the nearest pair) gives one by one. How
many cells are visited is measured for each length of vectors: a bounded sample is compared
with all, and the number is the smallest that reaches ``recall`` of its links as well as,
on average, of the links of each probe. For the average equal vectors are one, and of probes
linked with each other only the first counts, so a hot group weighs as much as a single
vector. Probes are taken until ``ENOUGH`` such ones have links or all vectors are probed; if
``MOST_PROBES`` do not suffice, all cells are visited.

Vectors meet in cells of their own label, in bounded blocks of visitors and residents,
and are compared by cosine in double precision. A link is found if either end visits the
other's cell; a resident knows which cells it visits itself, so each link counts once for
each end. Blocks give numbers of links and a spanning forest, never all pairs.

Codebooks are learned from at most ``SAMPLE`` different vectors (those of smallest hash), and
recall is measured with ``PROBES`` of them at a time; every vector is indexed.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows
with a null label, link with nothing and form their own component; vectors of different
length are not compared; rows with a null id are returned unlinked, with a null component
and kept; rows of equal id are one node of the graph: links to other ids count, once
per row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareto_frame.llm.common import stored
from pareto_frame.llm.components import components

SAMPLE, PROBES = 4096, 2048
#: Probes with links, none linked with another, that tell enough; probes of one length after which all cells are visited.
ENOUGH, MOST_PROBES = 400, 16384
#: Cells that are visited at least, for tables that have few links or none.
LEAST_VISITS = 4
#: Codewords of each half; vectors in a block.
WORDS, BLOCK = 16, 256
CELLS = WORDS * WORDS
STEPS = 12


class Index:
    """Codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, seed: int = 3) -> None:
        self.half = sample.shape[1] // 2
        self.books = [_kmeans(part, seed) for part in (sample[:, : self.half], sample[:, self.half :])]

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        parts = (vectors[:, : self.half], vectors[:, self.half :])
        return [
            (p * p).sum(1)[:, None] - 2 * p @ b.T + (b * b).sum(1)[None, :] for p, b in zip(parts, self.books)
        ]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        first, second = (d.argmin(1) for d in self.distances(vectors))
        return first * WORDS + second

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector and cell, how many cells the traversal visits before."""
        first, second = self.distances(vectors)
        both = np.full((len(vectors), WORDS, WORDS), np.inf)
        both[:, : first.shape[1], : second.shape[1]] = first[:, :, None] + second[:, None, :]
        return both.reshape(len(vectors), -1).argsort(1, kind="stable").argsort(1, kind="stable")

    def visits(self, vectors: np.ndarray, number: int) -> np.ndarray:
        """For each vector its ``number`` nearest cells, nearest first."""
        first, second = self.distances(vectors)
        return np.array([traverse(a, b, number) for a, b in zip(first, second)], np.int64).reshape(len(vectors), -1)


def traverse(first: np.ndarray, second: np.ndarray, number: int) -> list[int]:
    """Multi-sequence traversal: pairs of codewords by the sum of their distances."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < number:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * WORDS + int(b[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def _kmeans(points: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(WORDS, len(points)), replace=False)].copy()
    for _ in range(STEPS):
        nearest = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1)
        for i in range(len(centres)):
            if (nearest == i).any():
                centres[i] = points[nearest == i].mean(0)
    return centres


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


# tasks


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable rows with their unit vector in double precision."""
    for batch in batches:
        rows = []
        for one, label, vector in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if one is None or label is None or not vector or None in vector:
                continue
            v = np.array(vector, np.float64)
            if not np.isfinite(v).all() or not v.any():
                continue
            v = v / np.abs(v).max()
            rows.append((one, label, len(v), (v / np.sqrt(v @ v)).tobytes()))
        types = [pa.int64(), pa.string(), pa.int32(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["id", "label", "width", "v"]
        )


def _ranks(probes, index: dict[int, Index], least: float):
    """How many vectors and rows that each probe links with lie in the cell that it visits at each rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the traversal's order, over all cells at once
        at = {w: index[w].order(v) for w, (_, _, v) in probes.items()}
        total = {w: np.zeros((2, len(v) * CELLS), np.int64) for w, (_, _, v) in probes.items()}
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width, (ids, labels, vectors) in probes.items():
                rows = batch.filter(pa.array(widths == width))
                if not rows.num_rows:
                    continue
                found = _matrix(rows.column("v"))
                linked = vectors @ found.T >= least
                linked &= np.array(labels)[:, None] == np.array(rows.column("label").to_pylist())[None, :]
                linked &= ids[:, None] != rows.column("id").to_numpy()[None, :]
                p, r = np.nonzero(linked)
                if len(p):
                    place = p * CELLS + at[width][p, index[width].cells(found)[r]]
                    size = len(vectors) * CELLS
                    copies = rows.column("copies").to_numpy()[r]
                    total[width][0] += np.bincount(place, minlength=size)
                    total[width][1] += np.bincount(place, copies, minlength=size).astype(np.int64)
        for width, (n, copies) in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), width, np.int32)),
                    pa.array(used),
                    pa.array(n[used]),
                    pa.array(copies[used]),
                ],
                ["width", "place", "n", "copies"],
            )

    return run


def _placed(index: dict[int, Index], visits: dict[int, int]):
    """Each row with its cell and the cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                rows = batch.filter(pa.array(widths == width))
                found = index[int(width)].visits(_matrix(rows.column("v")), visits.get(int(width), CELLS))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(found[:, 0]), pa.array(list(found), pa.list_(pa.int64()))],
                    [*rows.schema.names, "cell", "visits"],
                )

    return run


def _compare(least: float):
    """Numbers of links and a spanning forest of one block of visitors and one of residents."""

    def run(key: tuple, guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        if guests.empty or hosts.empty:
            return empty
        g, h = guests["id"].to_numpy(), hosts["id"].to_numpy()
        linked = (_matrix(guests["v"]) @ _matrix(hosts["v"]).T >= least) & (g[:, None] != h[None, :])
        if not linked.any():
            return empty
        # a resident that visits the guest's cell counts the link itself
        home = guests["cell"].to_numpy()
        mutual = np.stack([np.isin(home, v) for v in hosts["visits"]], 1)
        per_guest, per_host = linked.sum(1), (linked & ~mutual).sum(0)
        ids = np.concatenate([g, h])
        counts = np.concatenate([per_guest, per_host])
        some = counts > 0
        rows = [(ids[some], ids[some], counts[some])]
        # spanning forest: the smallest id spreads along the links
        label_g, label_h = g.copy(), h.copy()
        big = np.iinfo(np.int64).max
        while True:
            new_g = np.minimum(label_g, np.where(linked, label_h[None, :], big).min(1))
            new_h = np.minimum(label_h, np.where(linked, new_g[:, None], big).min(0))
            if (new_g == label_g).all() and (new_h == label_h).all():
                break
            label_g, label_h = new_g, new_h
        ends, roots = np.concatenate([g, h]), np.concatenate([label_g, label_h])
        edge = ends != roots
        rows.append((ends[edge], roots[edge], np.zeros(edge.sum(), np.int64)))
        a, b, n = (np.concatenate(c) for c in zip(*rows))
        return pd.DataFrame({"a": a, "b": b, "n": n})

    return run


# the number of visited cells


class Measured:
    """What the probes of one length have told."""

    def __init__(self) -> None:
        self.probes, self.links, self.shares = 0, np.zeros(CELLS), np.zeros(CELLS)
        self.labels, self.vectors = [], []

    def add(self, labels: list[str], vectors: np.ndarray, copies: np.ndarray, n: np.ndarray, rows: np.ndarray, least: float):
        """``n`` and ``rows``: for each probe and rank the different vectors and the rows linked with it."""
        self.probes += len(vectors)
        self.links += copies @ rows
        for i in np.flatnonzero(n.sum(1)):
            same = [v for label, v in zip(self.labels, self.vectors) if label == labels[i]]
            if same and (np.array(same) @ vectors[i] >= least).any():
                continue
            self.labels.append(labels[i])
            self.vectors.append(vectors[i])
            self.shares += n[i] / n[i].sum()

    def settled(self, size: int) -> bool:
        return self.probes >= size or len(self.vectors) >= ENOUGH

    def visits(self, recall: float) -> int:
        """The least number that reaches ``recall`` of the links and of the links of each probe."""
        sums = [x.cumsum() for x in (self.links, self.shares)]
        return max(LEAST_VISITS, *(int(np.searchsorted(x, recall * x[-1])) + 1 for x in sums))


def measured_visits(different: DataFrame, index: dict[int, Index], least: float, recall: float) -> dict[int, int]:
    """For each length of ``index`` the number of cells to visit; ``different``: order, id, label, width, v, copies."""
    sizes = different.filter(F.col("width").isin([*index])).groupBy("width").count().toArrow().to_pylist()
    open_ = {row["width"]: row["count"] for row in sizes}
    told, visits, last = {w: Measured() for w in open_}, {}, None
    while open_:
        rest = different.filter(F.col("width").isin([*open_]))
        if last is not None:
            rest = rest.filter(F.struct("order", "id") > F.struct(*[F.lit(x).cast("long") for x in last]))
        some = rest.orderBy("order", "id").limit(PROBES).toArrow().to_pandas()
        if some.empty:
            break
        last = [int(x) for x in some[["order", "id"]].iloc[-1]]
        groups = {int(w): g for w, g in some.groupby("width")}
        probes = {w: (g["id"].to_numpy(), g["label"].tolist(), _matrix(g["v"])) for w, g in groups.items()}
        found = different.mapInArrow(_ranks(probes, index, least), "width int, place long, n long, copies long")
        # at most a row per probe and rank
        sums = found.groupBy("width", "place").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")).toArrow().to_pandas()
        for w, (_, labels, vectors) in probes.items():
            of = sums[sums["width"] == w]
            n, rows = np.zeros((2, len(vectors) * CELLS), np.int64)
            n[of["place"]], rows[of["place"]] = of["n"], of["copies"]
            shape = len(vectors), CELLS
            told[w].add(labels, vectors, groups[w]["copies"].to_numpy(), n.reshape(shape), rows.reshape(shape), least)
            if told[w].settled(open_[w]):
                visits[w] = told[w].visits(recall)
            if w in visits or told[w].probes >= MOST_PROBES:
                del open_[w]
    return visits


# the operator


def near_vectors(
    df: DataFrame,
    least: float = 0.93,
    recall: float = 0.995,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    every = df.select(F.col(vec_id).cast("long").alias("vec_id"))
    narrow = df.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    units = stored(narrow.mapInArrow(_unit, "id long, label string, width int, v binary"), "units").rows
    # equal vectors are one where codebooks are learned and recall is measured
    different = stored(
        units.groupBy("label", "width", "v")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .select(F.xxhash64("id", "label", "v").alias("order"), "id", "label", "width", "v", "copies"),
        "different",
    ).rows
    sample = different.orderBy("order", "id").limit(SAMPLE).toArrow().to_pandas()
    index = {int(width): Index(_matrix(rows["v"])) for width, rows in sample.groupby("width")}
    visits = measured_visits(different, index, least, recall)
    # lengths that the sample lacks: a codebook each from one of their rows
    others = units.filter(~F.col("width").isin([*index] or [-1])).groupBy("width").agg(F.min("v").alias("v"))
    for row in others.toLocalIterator():
        index[row["width"]] = Index(np.frombuffer(row["v"], np.float64).reshape(1, -1))
    placed = stored(
        units.mapInArrow(
            _placed(index, visits), "id long, label string, width int, v binary, cell long, visits array<long>"
        ),
        "placed",
    ).rows
    where = ["label", "width", "cell"]
    guests = placed.withColumn("home", F.col("cell")).withColumn("cell", F.explode("visits")).drop("visits")
    # blocks of residents and of visitors in each cell
    in_blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    residents = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("hosts"))
    visitors = guests.groupBy(*where).agg(F.count(F.lit(1)).alias("guests"))
    sizes = stored(
        residents.join(visitors, where).select(*where, in_blocks("hosts").alias("hs"), in_blocks("guests").alias("gs")),
        "cells",
    ).rows
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = [*where, "g", "h"]
    left = guests.join(sizes, where).select(
        *where, number("gs").alias("g"), all_of("hs").alias("h"), "id", "v", F.col("home").alias("cell_of")
    )
    # aliases, since both sides come from one table
    same = [F.col(c).alias(c) for c in (*where, "id", "v", "visits")]
    right = placed.join(sizes, where).select(*same, all_of("gs").alias("g"), number("hs").alias("h"))
    compare = _compare(least)

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return compare(key, a.drop(columns="cell").rename(columns={"cell_of": "cell"}), b)

    found = stored(
        left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(run, "a long, b long, n long"), "found"
    ).rows
    counts = found.filter("n > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    labels = components(found.filter("n = 0").select("a", "b")).withColumnRenamed("id", "vec_id")
    return (
        every.join(counts, "vec_id", "left")
        .join(labels, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
