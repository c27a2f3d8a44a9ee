"""Files of the measuring bench as DataFrames with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.cycle_logs import register_cycle_logs

CHIP = "ARRAY<STRUCT<chip_id STRING, label INT, ground_truth INT, category STRING, ev ARRAY<DOUBLE>>>"
CHIP_FILE = f"sampling_frequency_hz DOUBLE, clock_frequency_hz DOUBLE, n_samples BIGINT, eigenvector_dimension INT, training_chips {CHIP}, validation_chips {CHIP}"
MEMBER = "MAP<STRING, STRUCT<assigned_cluster STRING, ground_truth STRING, membership_golden DOUBLE, membership_trojan DOUBLE>>"


def read_cycle_logs(spark: SparkSession, path: str, min_bytes: int = 100, core: str = r"_([A-Za-z0-9]+)\.csv$", stream: bool = False) -> DataFrame:
    """Cycle logs of either header as one table with ``core`` from the file name, in volts.

    Files under ``min_bytes`` are stubs and skipped.  A file's first line tells its header; columns that a
    header lacks are null, as are fields that aren't numbers.  With ``stream`` new files are followed.
    """
    register_cycle_logs(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format("cycle_logs").option("min_bytes", min_bytes).option("core", core).load(path)


def read_chip_vectors(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``split, chip_id, label, category, ev`` from documents that list training and validation chips.

    A document is a file or, with ``lines``, a line, so that one file may hold any number of them.
    """
    files = spark.read.schema(CHIP_FILE).option("multiLine", not lines).json(path)
    part = lambda name, split: files.select(F.lit(split).alias("split"), F.explode(name).alias("c"))
    both = part("training_chips", "train").unionByName(part("validation_chips", "validation"))
    return both.select("split", "c.chip_id", F.coalesce("c.label", "c.ground_truth").alias("label"), "c.category", "c.ev")


def assignment_map(documents: Column | str) -> Column:
    """A JSON object keyed by chip as a map column; explode it for a row for each chip."""
    return F.from_json(documents, MEMBER)


def read_reports(spark: SparkSession, path: str, name: str = r"([^/]+?)(\.[^./]*)?$") -> DataFrame:
    """``report_id, value``: each text report as one row; ``name`` finds the id in its path, by default the file's name without its ending."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("report_id"), "value")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: each design source as one row."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), "value")


def write_traces(traces: DataFrame, path: str, partitions: Sequence[str] = ("split",)) -> None:
    """Wide traces as Parquet, in folders by split or condition so that a fit reads only its own."""
    traces.write.partitionBy(*partitions).mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str, as_json: bool = False) -> None:
    writer = rows.write.mode("overwrite")
    writer.json(path) if as_json else writer.parquet(path)
