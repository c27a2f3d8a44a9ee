"""Frequency grids and band windows, as small DataFrames made by Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.signal import to_bin


@dataclass(frozen=True)
class GridConfig:
    """Fixed values of the acquisition: sample rate, clock, bins of the positive half and the grid's shape."""

    sample_rate: float = 2.5e9
    clock: float = 10e6
    n_bins: int = 500_000
    below: int = 65
    above: int = 64
    first_above: float = 15e6
    last: float = 640e6
    half_width_hz: float = 500e3

    @property
    def half_width(self) -> int:
        return max(1, int(self.half_width_hz / (self.sample_rate / 2) * self.n_bins))


def linear_grid(spark: SparkSession, cfg: GridConfig = GridConfig(), rule: str = "round") -> DataFrame:
    """``k, freq_hz, bin``: evenly spaced up to the clock, then evenly spaced above it."""
    low = spark.range(cfg.below).select((F.col("id") + 1).cast("int").alias("k"), (F.col("id") * F.lit(cfg.clock / (cfg.below - 1))).alias("freq_hz"))
    step = (cfg.last - cfg.first_above) / (cfg.above - 1)
    high = spark.range(cfg.above).select((F.col("id") + cfg.below + 1).cast("int").alias("k"), (F.lit(cfg.first_above) + F.col("id") * F.lit(step)).alias("freq_hz"))
    return low.unionByName(high).withColumn("bin", to_bin(F.col("freq_hz"), cfg.sample_rate, cfg.n_bins, rule))


def eq3_grid(spark: SparkSession, cfg: GridConfig = GridConfig(), index_base: int = 0) -> DataFrame:
    """``k, bin``: clock dividers up to the clock's bin, then its multiples.  Halves are rounded up."""
    clock_bin = round(cfg.clock / (cfg.sample_rate / 2) * cfg.n_bins)
    k = F.col("id")
    divider = F.round(F.lit(float(clock_bin)) / (cfg.below + 1 - k))
    place = F.when(k <= cfg.below, divider).otherwise(F.lit(float(clock_bin)) * (k - cfg.below + 1))
    return spark.range(1, cfg.below + cfg.above + 1).select(k.cast("int").alias("k"), (place.cast("int") + F.lit(index_base)).alias("bin"))


def band_windows(grid: DataFrame, half_width: int, n_bins: int) -> DataFrame:
    """``grid`` with ``lo`` and ``hi``, the bins of each band; ``hi`` is the first one behind it."""
    return grid.withColumn("lo", F.greatest(F.lit(0), F.col("bin") - half_width)).withColumn("hi", F.least(F.lit(n_bins), F.col("bin") + half_width + 1))
