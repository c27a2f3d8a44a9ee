"""op13: the twenty best documents of every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm._tables import documents
from tracewell.llm.lexical import search

K = 20


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), K)


def _terms(table: str, key: str) -> str:
    return rf"SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table} WHERE text IS NOT NULL"


QUERIES = {"op13_lexical": op13_lexical}
ORACLE_SQL = {
    "op13_lexical": f"""
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms("documents", "doc_id")}) z GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n CROSS JOIN s),
w AS (SELECT term, CAST(floor(1000e0 * ln((2e0 * docs + 2e0) / (2e0 * df + 1e0))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1) d CROSS JOIN s),
q AS (SELECT item_id, term, count(*) AS times FROM ({_terms("benchmark", "item_id")}) z GROUP BY 1, 2),
r AS (
  SELECT item_id, p.doc_id AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w ON q.term = w.term JOIN p ON p.term = q.term JOIN m ON m.doc_id = p.doc_id GROUP BY 1, 2
),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {K}
""",
}
