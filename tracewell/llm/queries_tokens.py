"""op12: the tokens of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._tables import documents
from tracewell.llm.queries_packing import tokenizer_path
from tracewell.llm.tokencount import token_counts

LIMIT = 2048


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(documents(spark, sf_dir), tokenizer_path())
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op12_tokens": op12_tokens}
ORACLE_SQL: dict[str, str] = {}
