"""Scalar functions on samples, spectrums and feature vectors; all are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a norm before a division.
EPS = 1e-12


def to_bin(freq_hz: Column, sample_rate: float, n_bins: int, rule: str = "round") -> Column:
    """The spectrum bin of a frequency.  ``trunc`` cuts the fraction off, ``round`` takes the nearest bin."""
    place = freq_hz.cast("double") / F.lit(sample_rate / 2.0) * F.lit(float(n_bins - 1))
    if rule not in ("trunc", "round"):
        raise ValueError(f"unknown rule {rule!r}")
    whole = place.cast("int") if rule == "trunc" else F.round(place).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), whole))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def to_db(value: Column, reference: Column) -> Column:
    """Null where either is not positive."""
    ratio = F.when((value > 0) & (reference > 0), value / reference)
    return F.lit(20.0) * F.log10(ratio)


def from_db(db: Column, reference: Column) -> Column:
    return reference * F.pow(F.lit(10.0), db / 20.0)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column, norm: Column | None = None) -> Column:
    """``vector`` divided by its norm; a zero vector stays zero.  Give ``norm`` as a column to compute it once."""
    norm = l2_norm(vector) if norm is None else norm
    return F.transform(vector, lambda x: x.cast("double") / (norm + EPS))


def active_flag(triggered: Column, counter: Column) -> Column:
    return (triggered | (counter != 0)).cast("int")


def shunt_voltage(toggles: Column, modified: Column, active: Column, variant: str = "main") -> Column:
    """Millivolts over the shunt for a number of toggles.  Fixed values of the measured device family."""
    base = F.lit(8.5) + F.lit(0.150) * toggles
    if variant == "main":
        return base + F.when(modified & active, 0.350).when(modified, 0.035).otherwise(0.0)
    if variant == "base":
        return base + F.when(modified, 0.035).otherwise(0.0)
    raise ValueError(f"unknown variant {variant!r}")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def fmax_mhz(delay_ns: Column) -> Column:
    """The clock rate that a critical path allows; null for a delay of 0."""
    return F.try_divide(F.lit(1000.0), delay_ns)
