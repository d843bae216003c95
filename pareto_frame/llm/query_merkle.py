from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareto_frame.llm.common import read_table
from pareto_frame.llm.merkle import FIELDS, proof_digest, verified
from pareto_frame.llm.registry import register


def _leaf(text: str) -> str:
    fields = [text if f == "text" else f for f in FIELDS]
    encoded = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}, '-')" for f in fields]
    return f"sha256({' || '.join(encoded)})"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, text, {_leaf('text')} AS leaf, {_leaf("replace(text, chr(10), '')")} AS without,
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: list_transform(range(8), lambda i: (ascii(c)::BIGINT >> i) & 1)))) AS bits
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS size, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    xor(list_reduce(bits, lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 2 = 0 AS even
  FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, pos, size, leaf AS digest FROM numbered
  UNION ALL
  SELECT tree, level + 1, pos // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE size > 1 GROUP BY tree, level, size, pos // 3
), top AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(DISTINCT tree) FROM numbered) AS size, digest FROM nodes WHERE size = 1
  UNION ALL
  SELECT level + 1, pos // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM top WHERE size > 1 GROUP BY level, size, pos // 3
), steps AS (
  SELECT n.r, 0 AS tier, c.level, coalesce(string_agg(c.digest, '' ORDER BY c.pos) FILTER (c.pos < n.pos // (3 ** c.level)::BIGINT), '') AS l,
    coalesce(string_agg(c.digest, '' ORDER BY c.pos) FILTER (c.pos > n.pos // (3 ** c.level)::BIGINT), '') AS g
  FROM numbered n JOIN nodes c ON c.tree = n.tree AND c.size > 1 AND c.pos // 3 = n.pos // (3 ** (c.level + 1))::BIGINT GROUP BY n.r, c.level
  UNION ALL
  SELECT n.r, 1, c.level, coalesce(string_agg(c.digest, '' ORDER BY c.pos) FILTER (c.pos < n.tree // (3 ** c.level)::BIGINT), ''),
    coalesce(string_agg(c.digest, '' ORDER BY c.pos) FILTER (c.pos > n.tree // (3 ** c.level)::BIGINT), '')
  FROM numbered n JOIN top c ON c.size > 1 AND c.pos // 3 = n.tree // (3 ** (c.level + 1))::BIGINT GROUP BY n.r, c.level
), proofs AS (
  SELECT r, list(l ORDER BY tier, level) AS ls, list(g ORDER BY tier, level) AS gs, string_agg(l || g, '' ORDER BY tier, level) AS all_siblings
  FROM steps GROUP BY r
), folds AS (
  SELECT n.r, 1 AS i, CASE WHEN n.even AND n.text IS NOT NULL THEN n.without ELSE n.leaf END AS acc, p.ls, p.gs
  FROM numbered n LEFT JOIN proofs p USING (r)
  UNION ALL
  SELECT r, i + 1, sha256(ls[i] || acc || gs[i]), ls, gs FROM folds WHERE i <= coalesce(len(ls), 0)
)
SELECT n.doc_id, n.leaf, s.digest AS subroot, t.digest AS root, sha256(coalesce(p.all_siblings, '')) AS proof_sha256,
  f.acc AS folded_root, f.acc = t.digest AS verified
FROM numbered n JOIN nodes s ON s.tree = n.tree AND s.size = 1 JOIN top t ON t.size = 1 LEFT JOIN proofs p USING (r)
  JOIN folds f ON f.r = n.r AND f.i = coalesce(len(p.ls), 0) + 1
"""


@register("op13_merkle_manifest", SQL)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return verified(read_table(spark, folder, "documents")).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )
