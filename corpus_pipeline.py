"""The corpus pipeline: from ``documents`` to packed training sequences.

Stages, each on all that the one before kept:

1. language: documents whose language is rejected go.
2. lines: lines that repeat an earlier one, exactly or within one edit, go from the text;
   documents left without any line go.
3. near_duplicates: of each group of near-duplicates the document of smallest id stays.
4. secrets: secrets are replaced by their kind in brackets.
5. packing: the remaining documents are cut and packed; one row per piece.

``n_chars`` follows the text where it exists. Each stage returns the columns of its input,
but for the last. Null, empty and repeated rows are treated as the operators say: documents
without a letter go in stage 1; rows that share a ``doc_id`` stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareto_frame.llm.common import stored
from pareto_frame.llm.hyperminhash import near_duplicates
from pareto_frame.llm.language import predict, train
from pareto_frame.llm.lines import dedup_lines
from pareto_frame.llm.packing import cut, pack
from pareto_frame.llm.registry import ship_package
from pareto_frame.llm.secret_scan import find_secrets, redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No SQL states the language model or the sketches; tests compare with brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """What operators read, and the whole row beside it, so that no other name can clash with theirs."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def _unpacked(df: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of ``docs``; if the text has changed, with the new one and its length."""
    out = {c: F.col("__row").getField(c) for c in docs.columns}
    if changed:
        out["text"] = F.col("text")
        if "n_chars" in out:
            out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return df.select(*[column.alias(c) for c, column in out.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(predict(_packed(docs), train(docs)).filter(~F.col("rejected")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(_packed(docs))
    emptied = (F.size("removed") > 0) & (F.trim(F.col("text")) == "")
    return _unpacked(cleaned.filter(~F.coalesce(emptied, F.lit(False))), docs, changed=True)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    # both sides grow with the documents, so the join is shuffled at every size
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_secrets(_packed(docs))
    return _unpacked(found.withColumn("text", redact(F.col("text"), F.col("secret_spans"))), docs, changed=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(cut(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicate_documents),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name).rows
    return STAGES[-1][1](spark, docs, sf_dir)
