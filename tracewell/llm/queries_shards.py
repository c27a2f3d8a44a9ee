"""op2: documents into 24 shards of equal row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tables import documents
from tracewell.llm.sharding import two_pass_shuffle

SHARDS = 24


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = two_pass_shuffle(documents(spark, sf_dir).select("doc_id", "text"), SHARDS)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL: dict[str, str] = {}
