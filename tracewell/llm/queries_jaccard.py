"""op7: near-duplicate classes and link counts of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm._tables import documents
from tracewell.llm.jaccard import jaccard_join


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


QUERIES = {"op7_jaccard": op7_jaccard}
ORACLE_SQL = {
    "op7_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents) a
), s AS (
  SELECT DISTINCT doc_id, seq FROM (
    SELECT doc_id, n, count(*) OVER p AS own, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS at_, string_agg(word, ' ') OVER p AS seq
    FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) x
  WHERE own = 5 OR (n < 5 AND at_ = 1)
), z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.seq = b.seq AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE shared >= 0.8e0 * (x.size + y.size - shared) - 1e-9),
g AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, g.root FROM g JOIN l ON l.a = g.node),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT g.node AS doc_id, min(g.root) AS class_id, coalesce(max(links), 0) AS n_links FROM g LEFT JOIN n ON n.a = g.node GROUP BY g.node
""",
}
