"""op1: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tables import documents
from tracewell.llm.langid import predict, train_models


def held_out() -> F.Column:
    """Documents that nothing is learned from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = train_models(docs.where(~held_out()))
    found = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op1_langid": op1_langid}
ORACLE_SQL: dict[str, str] = {}
