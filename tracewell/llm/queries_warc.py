"""op8: pages into WARC archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tables import documents, written
from tracewell.llm.warc import read_records, write_archives


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(documents(spark, sf_dir, "pages"), "page_id", "url", "html")
    records = written(read_records(index).select("record_id", F.length("payload").cast("long").alias("own_bytes"), "payload_digest", "record_type", "refers_to"), "warc-records")
    held = index.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    sizes = records.where("record_type = 'response'").join(held, "record_id", "left_semi").groupBy("record_id").agg(F.max("own_bytes").alias("held_bytes"))
    revisits = records.where("record_type = 'revisit'").join(sizes.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    columns = lambda size: [F.col("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(*columns(F.col("own_bytes"))).unionByName(revisits.select(*columns(F.col("held_bytes"))))


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(floor(5 * g / 4) AS INTEGER) + 1, 2) AS BIGINT) >> CAST(3 - (5 * g) % 4 AS BIGINT)) & 31) + 1 AS BIGINT), 1), '' ORDER BY g) AS digest
  FROM p CROSS JOIN (SELECT range AS g FROM range(32)) r GROUP BY page_id
),
m AS (SELECT p.page_id AS page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, max(p.page_id) OVER (PARTITION BY digest, bytes) AS holder FROM p JOIN d ON p.page_id = d.page_id)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to FROM m
""",
}
