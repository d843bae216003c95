from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pareto_frame.llm.bpe import round_trip
from pareto_frame.llm.common import read_table
from pareto_frame.llm.registry import register


@register("op4_bpe_transducer")
def op4_bpe_transducer(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
