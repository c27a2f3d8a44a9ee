"""Spectrums of traces that are too long for one task: a Fourier transform in four steps over grouped blocks.

With N = N1 N2 a sample's place is n = N2 n1 + n2 and a bin k = k1 + N1 k2.  Samples are grouped by blocks of n2 and
transformed over n1; each result is turned by its twiddle factor exp(-2 pi i n2 k1 / N); what has equal k1 is grouped
again, in blocks, and transformed over n2.  A group holds ``BLOCK`` samples or one column (about the square root of N),
so that a task never gets a whole trace, and every sample is shuffled twice whatever the number of bins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples to a group.
BLOCK = 1 << 16


def factors(n: int) -> tuple[int, int]:
    """``N1 <= N2`` with the product ``n``, as near to each other as they can be; a prime has 1 and itself."""
    if n < 1:
        raise ValueError("a trace has a sample at least")
    first = next(f for f in range(math.isqrt(n), 0, -1) if n % f == 0)
    return first, n // first


def _keyed(key: tuple, table: pa.Table, by: Sequence[str], rows: int) -> list[pa.Array]:
    """The group's key columns, repeated for ``rows`` rows."""
    return [pa.array([key[j].as_py()] * rows, table.schema.field(name).type) for j, name in enumerate(by)]


def _columns_transformed(samples: DataFrame, n: int, by: Sequence[str], index: str, value: str, block: int) -> DataFrame:
    """``by, rows, first, re, im``: for blocks of k1 the turned transforms of a block of n2, row by row of k1.

    ``rows`` is the block of k1; ``first`` the first n2.
    """
    n1, n2 = factors(n)
    wide, high = max(1, block // n1), max(1, block // n2)
    kept = samples.where(F.col(index).between(0, n - 1)).select(*by, F.col(index).cast("long").alias("__i"), F.col(value).cast("double").alias("__d"))
    kept = kept.withColumn("__columns", F.floor(F.col("__i") % n2 / wide))
    schema = T.StructType([*(kept.schema[b] for b in by), T.StructField("__rows", T.LongType()), T.StructField("__first", T.LongType()), T.StructField("re", T.ArrayType(T.DoubleType())), T.StructField("im", T.ArrayType(T.DoubleType()))])

    def transform(key: tuple, table: pa.Table) -> pa.Table:
        first = key[-1].as_py() * wide
        width = min(wide, n2 - first)
        x = np.zeros((n1, width))
        at, d = table["__i"].to_numpy(), np.nan_to_num(table["__d"].to_numpy(zero_copy_only=False).astype(float))
        np.add.at(x, (at // n2, at % n2 - first), d)
        y = np.fft.fft(x, axis=0)
        turn = np.outer(np.arange(n1, dtype=np.int64), np.arange(first, first + width)) % n  # whole, so a long trace loses no digit
        y *= np.exp(-2j * np.pi * turn / n)
        starts = range(0, n1, high)
        parts = [y[a : a + high] for a in starts]
        lists = lambda real: pa.array([np.ascontiguousarray(p.real if real else p.imag).ravel() for p in parts], pa.list_(pa.float64()))
        return pa.table([*_keyed(key, table, by, len(parts)), pa.array([a // high for a in starts], pa.int64()), pa.array([first] * len(parts), pa.int64()), lists(True), lists(False)], names=schema.names)

    return kept.groupBy(*by, "__columns").applyInArrow(transform, schema)


def _rows_assembled(table: pa.Table, block: int, n1: int, n2: int, high: int) -> tuple[np.ndarray, int]:
    """The spectrum of a block of k1, shape ``(k1, k2)``, and its first k1."""
    a = block * high
    height = min(high, n1 - a)
    x = np.zeros((height, n2), complex)
    for first, re, im in zip(table["__first"].to_pylist(), table["re"], table["im"], strict=True):
        part = re.values.to_numpy() + 1j * im.values.to_numpy()
        part = part.reshape(height, -1)
        x[:, first : first + part.shape[1]] = part
    return np.fft.fft(x, axis=1), a


def long_spectrum(samples: DataFrame, n: int, by: Sequence[str] = ("chip",), index: str = "i", value: str = "d", block: int = BLOCK) -> DataFrame:
    """``by, bin, re, im, mag`` of every bin below ``n`` / 2, from long samples at the places 0 to ``n`` - 1.

    Missing and null samples count as 0, samples of one place are added, others are left out.
    """
    n1, n2 = factors(n)
    high = max(1, block // n2)
    half = _columns_transformed(samples, n, by, index, value, block)
    schema = T.StructType([*(half.schema[b] for b in by), T.StructField("bin", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("re", "im", "mag"))])

    def transform(key: tuple, table: pa.Table) -> pa.Table:
        y, a = _rows_assembled(table, key[-1].as_py(), n1, n2, high)
        bins = np.arange(a, a + len(y))[:, None] + n1 * np.arange(n2)[None, :]
        low = bins < n // 2
        y, bins = y[low], bins[low]
        return pa.table([*_keyed(key, table, by, len(bins)), pa.array(bins), pa.array(y.real.copy()), pa.array(y.imag.copy()), pa.array(np.abs(y))], names=schema.names)

    return half.groupBy(*by, "__rows").applyInArrow(transform, schema)


def long_features(samples: DataFrame, n: int, lo: Sequence[int], hi: Sequence[int], bins: Sequence[int], by: Sequence[str] = ("chip",), index: str = "i", value: str = "d", block: int = BLOCK) -> DataFrame:
    """``by, ev_band, ev_bin, raw_energy``: what ``features`` makes of whole traces, of long samples.

    Tasks sum the bands' energies over their own bins, so a few sums leave a block and no spectrum is shuffled.
    """
    n1, n2 = factors(n)
    high, d, half_n = max(1, block // n2), len(lo), n // 2
    low, top, single = (np.asarray(x, np.int64) for x in (lo, hi, bins))
    half = _columns_transformed(samples, n, by, index, value, block)
    schema = T.StructType([*(half.schema[b] for b in by), T.StructField("band", T.ArrayType(T.DoubleType())), T.StructField("single", T.ArrayType(T.DoubleType())), T.StructField("energy", T.DoubleType())])

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        y, a = _rows_assembled(table, key[-1].as_py(), n1, n2, high)
        square = y.real**2 + y.imag**2
        band, energy, own = np.zeros(d), 0.0, np.zeros(len(single))
        for r, row in enumerate(square):
            k1 = a + r  # its bins are k1, k1 + N1, ...: those of a range are a slice
            at = lambda k, k1=k1: np.clip(-((k1 - k) // n1), 0, n2)  # noqa: E731  the first place whose bin is k or more
            energy += row[: at(half_n)].sum()
            upto = np.stack([at(low), at(np.minimum(top, half_n))], axis=1).ravel()
            parts = np.add.reduceat(np.append(row, 0.0), upto)[::2]
            band += np.where(upto[1::2] > upto[::2], parts, 0.0)
            mine = np.flatnonzero(single % n1 == k1)
            own[mine] = row[single[mine] // n1]
        return pa.table([*_keyed(key, table, by, 1), *(pa.array([x], pa.list_(pa.float64())) for x in (band, own)), pa.array([float(energy)])], names=schema.names)

    parts = half.groupBy(*by, "__rows").applyInArrow(sums, schema)
    each = lambda name, size: [F.sum(F.get(name, F.lit(k))) for k in range(size)]
    widths = np.maximum(top - low, 1)
    total = parts.groupBy(*by).agg(F.array(*each("band", d)).alias("band"), F.array(*each("single", len(single))).alias("single"), F.sum("energy").alias("raw_energy"))
    rms = F.zip_with("band", F.array(*(F.lit(float(w)) for w in widths)), lambda s, w: F.sqrt(s / w))
    rows = total.select(*by, rms.alias("band"), F.transform("single", F.sqrt).alias("single"), "raw_energy")
    unit = lambda name: F.transform(name, lambda x: x / (F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, y: s + y * y)) + 1e-12))
    return rows.select(*by, unit("band").alias("ev_band"), unit("single").alias("ev_bin"), "raw_energy")
