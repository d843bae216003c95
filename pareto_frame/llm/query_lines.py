from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareto_frame.llm.common import read_table
from pareto_frame.llm.lines import MIN_CHARS, dedup_lines
from pareto_frame.llm.registry import register

#: Within one edit: a first part and the rest of both lines are equal around one character. Pairs
#: share one half of the shorter line, which the joins ask for.
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL
), once AS (
  SELECT line, min((doc_id, line_no)) AS place, length(line)::INT AS n FROM lines WHERE trim(line) <> '' GROUP BY line
), long AS (SELECT * FROM once WHERE n >= {MIN_CHARS}),
pairs AS (
  SELECT a.line AS x, b.line AS y, a.place AS px, b.place AS py, a.n FROM long a JOIN long b
    ON b.n = a.n AND left(a.line, a.n // 2) = left(b.line, b.n // 2)
  UNION SELECT a.line, b.line, a.place, b.place, a.n FROM long a JOIN long b
    ON b.n = a.n AND right(a.line, a.n - a.n // 2) = right(b.line, b.n - b.n // 2)
  UNION SELECT a.line, b.line, a.place, b.place, a.n FROM long a JOIN long b
    ON b.n - 1 = a.n AND left(a.line, a.n // 2) = left(b.line, (b.n - 1) // 2)
  UNION SELECT a.line, b.line, a.place, b.place, a.n FROM long a JOIN long b
    ON b.n - 1 = a.n AND right(a.line, a.n - a.n // 2) = right(b.line, b.n - 1 - (b.n - 1) // 2)
), near_pairs AS (
  SELECT * FROM pairs WHERE x <> y AND (
    (length(y) = n AND len(list_filter(range(0, n), lambda i: left(x, i::INT) = left(y, i::INT)
      AND substr(x, i::INT + 2) = substr(y, i::INT + 2))) > 0)
    OR (length(y) = n + 1 AND len(list_filter(range(0, n + 1), lambda i: left(x, i::INT) = left(y, i::INT)
      AND substr(x, i::INT + 1) = substr(y, i::INT + 2))) > 0))
), near AS (
  SELECT x AS line FROM near_pairs WHERE py < px UNION SELECT y FROM near_pairs WHERE px < py
), told AS (
  SELECT l.doc_id, l.line_no, l.line, o.place IS NOT NULL AND o.place <> (l.doc_id, l.line_no) AS is_exact,
    o.place IS NOT NULL AND o.place = (l.doc_id, l.line_no) AND l.line IN (SELECT line FROM near) AS is_near
  FROM lines l LEFT JOIN once o ON l.line = o.line
)
SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (is_exact)::INT AS n_exact, count(*) FILTER (is_near)::INT AS n_near,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_exact AND NOT is_near), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


@register("op1_line_dedup", SQL)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    with_number = docs.withColumn("n_lines", F.size(F.split("text", "\n", -1)))
    near = lambda wanted: F.size(F.filter("removed", lambda r: r["near"] == wanted))
    return dedup_lines(with_number).select(
        "doc_id",
        "n_lines",
        near(False).alias("n_exact"),
        near(True).alias("n_near"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
