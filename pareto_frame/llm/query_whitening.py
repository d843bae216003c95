from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pareto_frame.llm.common import read_table
from pareto_frame.llm.registry import register
from pareto_frame.llm.whitening import components_of


@register("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return components_of(read_table(spark, folder, "embeddings"))
