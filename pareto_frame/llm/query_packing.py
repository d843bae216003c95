from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pareto_frame.llm.common import read_table
from pareto_frame.llm.packing import cut, pack
from pareto_frame.llm.registry import register


@register("op3_bestfit_packing")
def op3_bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return pack(cut(docs, public_tokenizers.path("byte_bpe_50k.json")))
