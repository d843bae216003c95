from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareto_frame.llm.common import read_table
from pareto_frame.llm.language import held_out
from pareto_frame.llm.quality import score, train
from pareto_frame.llm.registry import register


@register("op11_quality_classifier")
def op11_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, folder, "labels").select("doc_id", "quality"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
