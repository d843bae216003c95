"""Tables stored by cell, with a zone map: files that cannot hold a result are not read.

Rows are written in the order of quantile cells of their dimensions, so a file covers a small box. The zone
map has one row per file: its lower corner and its *champion*, a row of smallest score. A file whose lower
corner some champion dominates holds no skyline row, nor a row that would dominate one which the champion
does not dominate as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pareto_frame.functions.dominance import every
from pareto_frame.functions.geometry import as_number, finite, has_number, rescale
from pareto_frame.operators.boxes import ORDER, z_order
from pareto_frame.operators.cleaning import quoted
from pareto_frame.operators.joins import BROADCAST_ROWS, survivors_of_many
from pareto_frame.operators.partitioning import tasks_for
from pareto_frame.plans.skyline import resolve_dims, skyline
from pareto_frame.session import Phase, materialise

FILE, COPIES = "__sky_file", "n_rows"
#: Files for each task from which on tasks write several files; the last one of a task may be small.
SHARED = 4


def _names(kind: str, n: int) -> list[str]:
    return [f"{kind}{i}" for i in range(n)]


def write_clustered(
    df: DataFrame, dims: Sequence[str | Column], folder: str, file_rows: int = 500_000
) -> Clustered:
    """Write ``df`` below ``folder`` in files of about ``file_rows`` neighbouring rows, and their zone map.

    Rows with a null dimension are stored apart. Rows that tie in all dimensions are ordered by a hash of
    the whole row, so a frequent tuple fills several files. Identical rows share a task, and, unless that writes
    several, a file.
    """
    _, exprs = resolve_dims(df, dims)
    xs = _names("__sky_x", len(exprs))
    placed = df.select("*", *[e.alias(x) for e, x in zip(exprs, xs, strict=True)])
    complete = every([F.col(x).isNotNull() for x in xs])
    types = {f.name: f.dataType for f in placed.schema.fields}
    if not all(has_number(types[x]) for x in xs):
        raise ValueError("dimensions of a clustered table are numbers, dates or times")
    narrow = placed.filter(complete).select(*xs)
    numbers = [finite(as_number(F.col(x), types[x])) for x in xs]
    ends = [f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(numbers) for f in (F.min, F.max)]
    known = narrow.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    base = folder.rstrip("/")
    df.filter(~every([e.isNotNull() for e in exprs])).write.parquet(f"{base}/incomplete")

    score = reduce(add, [_unit(F.col(x), types[x], known[f"min{i}"], known[f"max{i}"]) for i, x in enumerate(xs)])
    files = max(1, ceil(known["n"] / file_rows))
    tie = F.xxhash64(*[quoted(c) for c in df.columns]).alias("__sky_tie")
    ordered = z_order(narrow, xs)(placed.filter(complete)).select("*", tie)
    # a task for each file sends its result and its sample of the order to the driver, so many files share tasks
    tasks = tasks_for(df, known["n"], files)
    shared = files >= SHARED * tasks
    laid = ordered.repartitionByRange(tasks if shared else files, ORDER, *xs, "__sky_tie").sortWithinPartitions(ORDER, *xs)
    most = {"maxRecordsPerFile": file_rows} if shared else {}
    laid.select(*[quoted(c) for c in df.columns]).write.options(**most).parquet(f"{base}/rows")

    rows = df.sparkSession.read.schema(df.schema).parquet(f"{base}/rows")
    seen = rows.select(F.input_file_name().alias(FILE), *[e.alias(x) for e, x in zip(exprs, xs, strict=True)])
    best = F.min(F.struct(score.alias("score"), *xs)).alias("best")
    low = [F.min(x).alias(n) for x, n in zip(xs, _names("low", len(xs)), strict=True)]
    zones = seen.groupBy(FILE).agg(F.count(F.lit(1)).alias(COPIES), *low, best)
    champions = [F.col("best").getField(x).alias(n) for x, n in zip(xs, _names("best", len(xs)), strict=True)]
    zones.select(
        FILE, COPIES, F.array(*[F.lit(str(e)) for e in exprs]).alias("dims"), *_names("low", len(xs)), *champions
    ).write.parquet(f"{base}/zones")
    return Clustered(df.sparkSession, base)


def _unit(x: Column, dtype, low: float | None, high: float | None) -> Column:
    scaled = rescale(as_number(x, dtype), F.lit(low or 0.0), F.lit(high or 0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


@dataclass(frozen=True)
class Clustered:
    """A table written by ``write_clustered``."""

    spark: SparkSession
    folder: str

    @property
    def zones(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/zones")

    def rows(self, files: DataFrame | None = None) -> DataFrame:
        """Rows with complete dimensions, of all files or of those named in FILE."""
        if files is None:
            return self.spark.read.parquet(f"{self.folder}/rows")
        # one name per file that is left to read
        paths = [r[FILE] for r in files.select(FILE).toArrow().to_pylist()]
        schema = self.spark.read.parquet(f"{self.folder}/rows").schema
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def incomplete(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/incomplete")

    def files_left(self, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """Zones of the files that no champion rules out."""
        zones = materialise(self.zones)
        n = sum(c.startswith("low") for c in zones.rows.columns)
        xs = _names("__sky_x", n)
        champions = zones.rows.select(*[F.col(b).alias(x) for b, x in zip(_names("best", n), xs, strict=True)])
        strongest = materialise(skyline(champions, xs, ties="distinct", broadcast_rows=broadcast_rows))
        low = zones.rows.withColumns({x: F.col(c) for x, c in zip(xs, _names("low", n), strict=True)})
        return survivors_of_many(low, xs, Phase(strongest.rows, strongest.count), broadcast_rows).drop(*xs)

    def skyline(
        self, dims: Sequence[str | Column], strategy: str = "auto", *, nulls: str = "drop", **settings
    ) -> DataFrame:
        """As ``skyline`` over the whole table, which has to be written with the same ``dims``."""
        _, exprs = resolve_dims(self.rows(), dims)
        written = self.zones.select("dims").limit(1).toArrow().to_pylist()
        if written and written[0]["dims"] != [str(e) for e in exprs]:
            raise ValueError(f"the table is clustered by {written[0]['dims']}")
        left = self.rows(self.files_left(settings.get("broadcast_rows", BROADCAST_ROWS)))
        if nulls == "keep":
            left = left.unionByName(self.incomplete())
        return skyline(left, dims, strategy, nulls=nulls, **settings)
