"""Jobs on traces and cycle logs in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.randoms import hash_normal
from tracewell.functions.signal import clip


def lockstep(golden: DataFrame, modified: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """``on, golden, modified`` of two logs, cycle by cycle; cycles that one log lacks are left out."""
    left = golden.select(*on, F.col(value).alias("golden"))
    right = modified.select(*on, F.col(value).alias("modified"))
    return left.join(right, list(on))


def differential(golden: DataFrame, modified: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    return lockstep(golden, modified, on, value).withColumn("delta", F.col("modified") - F.col("golden"))


def parity_mismatches(golden: DataFrame, modified: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """The cycles that both logs have but with different outputs; null equals null only."""
    return lockstep(golden, modified, on, value).where(~F.col("golden").eqNullSafe(F.col("modified")))


def average_repeats(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The mean over repeated acquisitions; partial means leave little to shuffle."""
    return samples.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("repeats"))


def hamming_toggles(states: DataFrame, by: Sequence[str], order: Sequence[str], states_in: Sequence[str], counter: Column | None = None, variant: str = "main") -> DataFrame:
    """``states`` with ``toggles``: bits that differ from the previous state of the same core (at first: from 0).

    A state may span several integer columns.  A modified core's counter adds 1 while it isn't 0 (``main``) or
    the bits that changed in it (``base``).  Rows are partitioned by ``by``: give a run or a block of cycles
    besides the core, since a core alone would be one task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    changed = lambda c: F.bit_count(c.bitwiseXOR(F.lag(c, 1, 0).over(w)))
    toggles = sum((changed(F.coalesce(F.col(s).cast("long"), F.lit(0).cast("long"))) for s in states_in), F.lit(0))
    if counter is not None:
        toggles = toggles + (F.when(counter != 0, 1).otherwise(0) if variant == "main" else changed(counter.cast("long")))
    return states.withColumn("toggles", toggles.cast("int"))


def toggle_summary(logs: DataFrame, modified: Column, toggles: str = "toggles") -> DataFrame:
    """One row: mean toggles of both cores and the difference in percent; null where a core is missing."""
    means = logs.agg(F.avg(F.when(~modified, F.col(toggles))).alias("mean_golden"), F.avg(F.when(modified, F.col(toggles))).alias("mean_modified"))
    return means.withColumn("delta_pct", F.try_divide(100 * (F.col("mean_modified") - F.col("mean_golden")), F.col("mean_golden")))


def low_toggle_patterns(logs: DataFrame, pattern: str, toggles: str, k: int = 10) -> DataFrame:
    """The ``k`` patterns with the fewest toggles; ties go to the smaller pattern."""
    totals = logs.groupBy(pattern).agg(F.sum(toggles).alias("total_toggles"))
    return totals.orderBy("total_toggles", pattern).limit(k)


def signal_power(samples: DataFrame, by: Sequence[str], value: str = "d") -> DataFrame:
    return samples.groupBy(*by).agg(F.avg(F.col(value) * F.col(value)).alias("power"))


def noise_variance(power: Column, snr_db: float | Column) -> Column:
    return power / F.pow(F.lit(10.0), (F.lit(snr_db) if isinstance(snr_db, (int, float)) else snr_db) / 10.0)


def add_noise(samples: DataFrame, snr_db: float, seed: int, by: Sequence[str] = ("chip",), index: str = "i", value: str = "d") -> DataFrame:
    """White Gaussian noise at a signal-to-noise ratio; a sample's noise depends on its trace, place and the seed.

    A trace's power comes from a window over it, so the samples are made and shuffled once.
    """
    power = F.avg(F.col(value) * F.col(value)).over(Window.partitionBy(*by))
    noise = F.sqrt(noise_variance(power, snr_db)) * hash_normal(*(F.col(b) for b in by), F.col(index), F.lit(seed))
    return samples.withColumn(value, F.col(value) + noise)


def die_gain(samples: DataFrame, sigma: float, seed: int, chip: str = "chip", value: str = "d") -> DataFrame:
    """Every trace of a chip scaled by the chip's gain, normal around 1."""
    return samples.withColumn(value, F.col(value) * (1 + F.lit(sigma) * hash_normal(F.col(chip), F.lit(seed))))


def drift_resample(samples: DataFrame, pct: float, n: int, by: Sequence[str] = ("chip",), index: str = "i", value: str = "d") -> DataFrame:
    """Samples at their index times ``1 + pct / 100``, between neighbours by linear interpolation, clamped at the ends.

    The map of places is monotone, so each sample, with its successor from a window, makes the new samples that lie
    between the two: one shuffle by trace and no join.  Traces have the samples 0 to ``n`` - 1; where the successor is
    missing, samples between are null.  Other columns belong to the trace and come from the sample at the mapped place.
    """
    factor = 1 + pct / 100
    if factor <= 0:
        raise ValueError("pct must be above -100")
    order = Window.partitionBy(*by).orderBy(index)
    at = lambda i: F.least(F.lit(float(n - 1)), i * F.lit(factor))
    rows = samples.withColumn("__next", F.when(F.lead(index).over(order) == F.col(index) + 1, F.lead(value).over(order)))
    # The ends follow by division; rounding may move them by one.
    place, off = F.col(index), lambda j: F.floor(at(j))
    first = F.greatest(F.lit(0), F.ceil(place / F.lit(factor))).cast("long")
    first = F.when((first > 0) & (off(first - 1) >= place), first - 1).when(off(first) < place, first + 1).otherwise(first)
    last = (F.ceil((place + 1) / F.lit(factor)) - 1).cast("long")
    last = F.when(off(last + 1) <= place, last + 1).when(off(last) > place, last - 1).otherwise(last)
    last = F.when(place >= n - 1, F.lit(n - 1).cast("long")).otherwise(F.least(F.lit(n - 1).cast("long"), last))
    rows = rows.withColumn("__first", first).withColumn("__last", last).where("__first <= __last").withColumn("__to", F.explode(F.sequence("__first", "__last")))
    share = at(F.col("__to")) - F.col(index)
    new = F.when(share == 0, F.col(value)).otherwise(F.col(value) * (1 - share) + F.col("__next") * share)
    return rows.withColumn(value, new).withColumn(index, F.col("__to").cast(samples.schema[index].dataType)).select(*samples.columns)


def clip_samples(samples: DataFrame, low: float, high: float, value: str = "d") -> DataFrame:
    return samples.withColumn(value, clip(F.col(value), low, high))


def spectrum_slice(spectrum: DataFrame, first: int, last: int) -> DataFrame:
    """The bins from ``first`` to ``last``."""
    return spectrum.where(F.col("bin").between(first, last))
