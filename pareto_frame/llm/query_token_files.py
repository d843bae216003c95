from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pareto_frame.llm.common import read_table
from pareto_frame.llm.registry import register
from pareto_frame.llm.token_files import read_documents, write_tokens


@register("op10_token_files")
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    files = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, files)
