from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pareto_frame.llm.common import read_table
from pareto_frame.llm.hyperminhash import near_duplicates
from pareto_frame.llm.registry import register


@register("op5_hyperminhash")
def op5_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents").select("doc_id", "text"))
