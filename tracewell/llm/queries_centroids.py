"""op11: embeddings as integers in 16 clusters after three rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tables import documents
from tracewell.llm.centroids import cluster, first_by_hash, whole_vectors, with_inertia

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
RESULT = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = documents(spark, sf_dir, "embeddings")
    vectors = whole_vectors(table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("q")), "q", DIMS, SCALE)
    start = first_by_hash(vectors, F.concat(F.lit("1:"), F.col("id").cast("string")), "q", CENTROIDS)
    if not len(start):
        return spark.createDataFrame([], RESULT.format(table.schema["vec_id"].dataType.simpleString()))
    return with_inertia(cluster(vectors, start, ROUNDS)).withColumnRenamed("id", "vec_id")


def _rounds() -> str:
    out = []
    for n in range(ROUNDS + 1):
        out.append(f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, j, d FROM (
    SELECT e.vec_id AS vec_id, c.j AS j, CAST(sum((e.v - c.v) * (e.v - c.v)) AS BIGINT) AS d, row_number() OVER (PARTITION BY e.vec_id ORDER BY sum((e.v - c.v) * (e.v - c.v)), c.j) AS place
    FROM e JOIN c{n} c ON e.i = c.i GROUP BY e.vec_id, c.j) z WHERE place = 1
)""")
        if n < ROUNDS:
            out.append(f"""
m{n + 1} AS (SELECT a.j AS j, e.i AS i, CAST(floor(CAST(sum(e.v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM e JOIN a{n} a ON e.vec_id = a.vec_id GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c.j AS j, c.i AS i, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n + 1} m ON c.j = m.j AND c.i = m.i)""")
    return ",".join(out)


QUERIES = {"op11_clusters": op11_clusters}
ORACLE_SQL = {
    "op11_clusters": f"""
WITH k AS (
  SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {DIMS}
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
),
e AS MATERIALIZED (SELECT vec_id, i, CAST(floor({SCALE}e0 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(range(1, {DIMS + 1})) AS i FROM k) z),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS j FROM k),
c0 AS MATERIALIZED (SELECT s.j AS j, e.i AS i, e.v AS v FROM s JOIN e ON s.vec_id = e.vec_id WHERE s.j < {CENTROIDS}),{_rounds()},
h AS (SELECT j, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS hash FROM c{ROUNDS} GROUP BY j)
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, hash AS centroid_sha256
FROM a{ROUNDS} a JOIN h ON a.j = h.j
""",
}
