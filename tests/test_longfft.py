from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import longfft
from tracewell.operators.longfft import _columns_transformed, factors, long_features, long_spectrum
from tracewell.operators.spectral import features


@pytest.mark.parametrize(("n", "block"), [(720, 64), (720, 1 << 16), (97, 10), (1, 1), (49, 7), (60, 1)])
def test_spectrum_equals_numpy(spark, n, block):
    rng = np.random.default_rng(n)
    x = {"a": rng.normal(size=n), "b": rng.normal(size=n)}
    rows = [(c, i, float(v)) for c, values in x.items() for i, v in enumerate(values)] + [("a", n, 5.0), ("a", -1, 5.0), ("b", None, 5.0), ("b", 0, None)]
    found = long_spectrum(spark.createDataFrame(rows, "chip string, i int, d double").repartition(3), n, block=block).collect()
    assert len(found) == 2 * (n // 2)
    for r in found:
        y = np.fft.fft(x[r.chip])[r.bin]
        assert abs(r.re - y.real) < 1e-9 and abs(r.im - y.imag) < 1e-9 and abs(r.mag - abs(y)) < 1e-9


def test_factors():
    assert factors(1_000_000) == (1000, 1000) and factors(720) == (24, 30) and factors(97) == (1, 97) and factors(1) == (1, 1)
    with pytest.raises(ValueError, match="sample"):
        factors(0)


@pytest.mark.parametrize("block", [50, 1 << 16])
def test_features_equal_whole_traces(spark, block):
    rng = np.random.default_rng(2)
    n, lo, hi, bins = 360, [0, 10, 11, 100, 5], [1, 12, 40, 180, 5], [0, 7, 7, 179]
    x = {None: rng.normal(size=n), 2: rng.normal(size=n), 3: np.zeros(n)}
    rows = [(c, i, float(v)) for c, values in x.items() for i, v in enumerate(values) if c != 3 or i < 2]
    found = {r.chip: r for r in long_features(spark.createDataFrame(rows, "chip int, i int, d double").repartition(3), n, lo, hi, bins, block=block).collect()}
    whole = spark.createDataFrame([(c, v.tolist()) for c, v in x.items()], "chip int, samples array<double>")
    for r in features(whole, lo, hi, bins).collect():
        own = found[r.chip]
        assert np.allclose(own.ev_band, r.ev_band) and np.allclose(own.ev_bin, r.ev_bin) and np.isclose(own.raw_energy, r.raw_energy)
    assert long_features(spark.createDataFrame([], "chip int, i int, d double"), n, lo, hi, bins).count() == 0


def test_no_task_gets_a_long_trace(spark):
    """A million samples: groups of 2^16 at most on both sides, dealt over tasks, and the right tones."""
    n = 1 << 20
    tone = F.cos(2 * np.pi * F.pmod(F.col("id") * 12_345, F.lit(n)) / n) + 0.001 * F.sin(2 * np.pi * F.pmod(F.col("id") * 400_001, F.lit(n)) / n)
    samples = spark.range(n).select(F.lit("long").alias("chip"), F.col("id").alias("i"), tone.alias("d"))
    half = _columns_transformed(samples, n, ["chip"], "i", "d", longfft.BLOCK)
    sizes = half.groupBy("chip", "__rows").agg(F.sum(F.size("re")).alias("n")).collect()
    assert len(sizes) == 16 and {r.n for r in sizes} == {1 << 16}
    tasks = samples.withColumn("__columns", F.floor(F.col("i") % 1024 / 64)).groupBy("chip", "__columns").count().collect()
    assert len(tasks) == 16 and {r["count"] for r in tasks} == {1 << 16}
    r = long_features(samples, n, [12_340, 399_990], [12_350, 400_010], [12_345, 400_001, 77]).first()
    assert np.isclose(r.raw_energy, (n / 2) ** 2 * (1 + 1e-6), rtol=1e-9)
    assert np.isclose(r.ev_bin[1] / r.ev_bin[0], 1e-3, rtol=1e-6) and r.ev_bin[2] < 1e-9
