"""Verdicts of a stream of traces against models that change while it runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.sources.models import latest_version, load_version
from tracewell.streaming.jobs import score_stream


def version_of_batch(spark: SparkSession, models: str, decisions: str, batch_id: int) -> int:
    """The version that a batch is judged by: the latest one when it first ran, and the same when it runs again."""
    place = f"{decisions}/batch={batch_id}"
    try:
        known = spark.read.schema("version int").parquet(place).collect()
    except AnalysisException:
        known = []
    if known:
        return known[0].version
    version = latest_version(spark, models)
    if not version:
        raise ValueError(f"no model in {models}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(place)
    return version


def verdict_stream(stream: DataFrame, models: str, out: str, checkpoint: str, lo: Sequence[int], hi: Sequence[int], bins: Sequence[int], by: Sequence[str] = (), available_now: bool = False) -> StreamingQuery:
    """Starts a query that writes the verdict of each trace to ``out``, with the ``version`` of the model and the ``batch``.

    ``models`` is a store of ``publish_detectors``; each batch takes the latest version there.  A batch's verdicts are a folder
    that is replaced whole, and the version of a batch is written down before its verdicts.  So a batch that runs again after
    a stop, or a writer that is lost, leaves each trace once and with the verdict that it had.
    """
    decisions = f"{checkpoint}/models"

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = version_of_batch(spark, models, decisions, batch_id)
        verdicts = score_stream(batch, load_version(spark, models, version), lo, hi, bins, by)
        verdicts.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """All verdicts so far, with ``version`` and ``batch``."""
    return spark.read.parquet(out)
