from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pareto_frame.llm.common import read_table
from pareto_frame.llm.registry import register
from pareto_frame.llm.secret_scan import BASE_RULES, MORE_RULES, find_secrets, spelled

#: Kind, pattern, group, least length; the base rules stand here as the contract has them.
SQL_RULES = [
    ("assign", BASE_RULES[0].java, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    *[(r.kind, r.java, r.group, r.least) for r in MORE_RULES],
]


def _sql_matches(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT n, {order} AS place, '{kind}' AS kind, "end" - length(m) AS start, "end" FROM (
    SELECT n, m, v, sum(length(g) + length(m)) OVER (PARTITION BY n ORDER BY i)::BIGINT AS "end" FROM (
      SELECT n, unnest(string_split_regex(text, {quoted})) AS g, unnest(regexp_extract_all(text, {quoted}, 0)) AS m,
        unnest(regexp_extract_all(text, {quoted}, {group})) AS v, generate_subscripts(string_split_regex(text, {quoted}), 1) AS i
      FROM docs WHERE regexp_matches(text, {quoted}))
    WHERE m IS NOT NULL)
  WHERE length(v) >= {least}"""


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_sql_matches(i, *rule) for i, rule in enumerate(SQL_RULES))}),
told AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, place) FILTER (place < 3) AS base,
    string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY n)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (n)
"""


@register("op8_secret_scan", SQL)
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))


    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(rule.kind) for rule in BASE_RULES]
    return (
        find_secrets(docs)
        .select("doc_id", "secret_spans")
        .select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(spans).alias("spans"))
    )
