"""The pipeline's stages, the registered queries against their SQL, and what stays native."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pareto_frame.llm import chat, secret_scan
from pareto_frame.llm.common import stored
from pareto_frame.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import documents

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted((tuple(r[i] for i in order) for r in answer.fetchall()), key=repr)


@needs_tables
def test_native_plans_have_no_python(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df in (chat.digests(chat.format_conversations(turns)), secret_scan.find_secrets(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_stages(spark):
    docs = stored(documents(spark), "odd").rows
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, ""), name)
        assert out.rows.columns == docs.columns and out.rows.dtypes == docs.dtypes
        assert out.count <= kept
        if name == "language":
            gone = docs.join(out.rows.select("text").distinct(), "text", "left_anti")
            assert all(not any(c.isalpha() for c in r.text or "") for r in gone.collect())
        if name == "secrets":
            clean = secret_scan.find_secrets(out.rows).filter(F.size("secret_spans") > 0)
            assert out.count == kept and clean.count() == 0
        docs, kept = out.rows, out.count
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert pieces.filter("piece = 0").count() == kept


def test_stages_on_nothing(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name).rows
        assert docs.count() == 0
