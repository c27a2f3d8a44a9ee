"""op6: documents without the 13-word windows of earlier documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tables import documents
from tracewell.llm.substrings import remove_repeats


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op6_substrings": op6_substrings}
ORACLE_SQL = {
    "op6_substrings": r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents) a
), k AS (
  SELECT doc_id, pos, count(*) OVER s AS n, string_agg(word, ' ') OVER s AS seq
  FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), f AS (SELECT seq, min(doc_id) AS first FROM k WHERE n = 13 GROUP BY seq HAVING min(doc_id) < max(doc_id)),
m AS (SELECT DISTINCT k.doc_id AS doc_id, k.pos + o.range AS pos FROM k JOIN f ON k.seq = f.seq AND k.doc_id > f.first CROSS JOIN range(13) o WHERE k.n = 13),
r AS (
  SELECT w.doc_id AS doc_id, count(*) AS n_words, count(m.pos) AS n_removed, string_agg(CASE WHEN m.pos IS NULL THEN word END, ' ' ORDER BY w.pos) AS kept
  FROM w LEFT JOIN m ON w.doc_id = m.doc_id AND w.pos = m.pos GROUP BY w.doc_id
)
SELECT d.doc_id AS doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
""",
}
