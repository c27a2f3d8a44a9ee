"""op5: documents mixed to the weights 1, 2, 3 of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tables import documents
from tracewell.llm.mixing import mix

#: Sampling weights of documents that are labelled good or bad; 1 without a label.
GOOD, BAD = 2.0, 0.5


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = documents(spark, sf_dir, "labels").where("quality is not null and doc_id is not null")
    return labels.select("doc_id", F.when(F.col("quality") > 0, GOOD).otherwise(BAD).alias("weight"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), (1, 2, 3), quality_weights(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL = {
    "op5_mixing": r"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality > 0 THEN 2e0 ELSE 0.5e0 END) AS w FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
s AS (
  SELECT d.doc_id AS doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((CAST(CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || '|' || md5(coalesce(text, '')) || '|29'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0) / coalesce(q.w, 1e0) AS key
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id
),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s GROUP BY source),
v AS (SELECT source, source_size, 3e0 * source_size AS cap, CAST(rk % 3 + 1 AS DOUBLE) AS wt FROM t WHERE source_size > 0),
o AS (
  SELECT *, cap / wt AS full_at,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(wt) OVER (ORDER BY cap / wt, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM v
),
u AS (SELECT unit FROM o WHERE unit <= full_at ORDER BY full_at, source LIMIT 1),
g AS (SELECT t.source AS source, t.source_size AS source_size, coalesce(least(v.cap, u.unit * v.wt), 0e0) AS target FROM t CROSS JOIN u LEFT JOIN v ON t.source IS NOT DISTINCT FROM v.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g),
b AS (
  SELECT s.doc_id AS doc_id, s.size AS size, p.source_size AS source_size, p.target AS target, p.epochs AS epochs, round(p.target - p.epochs * p.source_size) AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM b
""",
}
