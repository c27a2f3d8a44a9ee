"""op10: the ten nearest sign codes of every fiftieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tables import documents
from tracewell.llm.hamming import sign_code, top_k

K = 10


def op10_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings").where("embedding is not null and size(embedding) > 0")
    base = vectors.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    found = top_k(base, base.where("id % 50 = 0"), K)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


QUERIES = {"op10_hamming": op10_hamming}
ORACLE_SQL = {
    "op10_hamming": """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL),
b AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding FROM v),
s AS (SELECT vec_id, i, coalesce(embedding[i] > 0, false) AS bit FROM b),
d AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(sum(CASE WHEN q.bit <> x.bit THEN 1 ELSE 0 END) AS INTEGER) AS distance
  FROM s q JOIN s x ON q.i = x.i WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, x.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
""",
}
