"""op3: fingerprints of the documents, of edited documents, and their likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tables import documents
from tracewell.llm.fingerprints import as_text, resemblance, with_next, with_sketch


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, following = with_next(documents(spark, sf_dir))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("following", following("text"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - moved), F.substring("following", F.lit(1), moved))
    rows = rows.withColumn("edited", edited).drop("following")
    rows = with_sketch(with_sketch(rows, "text", "sketch"), "edited", "edited_sketch")
    rows = rows.select("doc_id", "block", "tail", "tie", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "edited_sketch")
    rows = rows.withColumn("next_sketch", following("sketch")).where("tail = 0")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLE_SQL: dict[str, str] = {}
