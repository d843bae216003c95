"""Connected components of a link table, by large-star and small-star rounds.

Each round hangs the neighbours of every node on the smallest node near it, by joins and
minima, until nothing changes; links and labels stay distributed, and each round is
written to the shared folder. Joins on a node with very many links may be split by
Spark, minima are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareto_frame.llm.common import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (a, b), a > b. Large: each larger neighbour meets the smallest; small: each smaller or equal."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id of ``links`` (a, b); the component is its smallest id.

    Links with a null end and loops are ignored; repeated links count once.
    """
    pairs = stored(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    while pairs.count:
        large = _star(pairs.rows, True)
        pairs = stored(_star(large, False), "links")
        # stars are stable once both rounds leave the same number and sum of links
        now = pairs.rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return (
        pairs.rows.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        .unionByName(pairs.rows.select(F.col("b").alias("id"), F.col("b").alias("component_id")))
        .distinct()
    )
