from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pareto_frame.llm.common import read_table
from pareto_frame.llm.registry import register
from pareto_frame.llm.vectors import near_vectors


@register("op6_multi_index")
def op6_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read_table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
