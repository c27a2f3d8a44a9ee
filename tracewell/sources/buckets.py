"""Cycle logs as tables in buckets: rows of one run lie together and in order, so that jobs by run shuffle nothing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tracewell.sources.shared import new_path

#: Bytes of a bucket's file that one task reads with ease.
BUCKET_BYTES = 128 << 20


def bucket_count(n_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for a log of a known size: logs that are compared must have the same number."""
    return max(1, -(-n_bytes // bucket_bytes))


def write_buckets(log: DataFrame, by: Sequence[str], order: Sequence[str], buckets: int, name: str = "log", path: str | None = None) -> DataFrame:
    """Writes ``log`` as a table of ``buckets`` buckets by ``by``, sorted by ``by`` and ``order``, and reads it.

    A join of two such tables on ``by`` (or on more columns) with the same number of buckets, a window over ``by`` and a
    grouping by it need no exchange: Spark knows how the table is dealt.  The rows are dealt by the same hash before they are
    written, so that a bucket is one file and not one of each task.
    """
    spark, table = log.sparkSession, f"{name}_{uuid.uuid4().hex}"
    dealt = log.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, *by).sortBy(*by, *order).option("path", path or new_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)
