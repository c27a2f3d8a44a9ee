"""From traces to feature vectors: selected-bin DFT, full spectrums, band and single-bin features."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import _kernels
from tracewell.functions.signal import magnitude


#: Samples of a trace that are dealt out together, and bins that a batch is transformed at together.
BLOCK, CHUNK = 1 << 16, 64


def dft_bins(samples: DataFrame, bins: Sequence[int], n: int, by: Sequence[str] = ("chip",), index: str = "i", value: str = "d") -> DataFrame:
    """``by, bin, re, im, mag`` of long samples at a few bins.

    Samples are dealt out by trace (of longer ones by block), which those that are so already needn't be; a batch of them
    becomes a row of sums for each of its traces and bins, so no sample is repeated for the bins.  The phase is reduced
    modulo ``n`` as an integer, so its cosine loses nothing on long traces.  Null samples are left out; a trace
    without others has null sums.  For all bins of a trace use ``features``.
    """
    wanted = np.array(sorted({int(b) for b in bins}), np.int64)
    place = F.col(index).cast("long")
    rows = samples.select(*by, place.alias("__i"), F.col(value).cast("double").alias("__d"))
    rows = rows.repartition(*by) if n <= BLOCK else rows.repartition(*by, F.floor(F.col("__i") / BLOCK))
    schema = T.StructType([*(rows.schema[b] for b in by), T.StructField("bin", T.IntegerType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.table({b: batch[b] for b in by} | {"__at": pa.array(np.arange(batch.num_rows))}).group_by(list(by), use_threads=False).aggregate([("__at", "list")])
            places = keys["__at_list"].combine_chunks()
            starts, order = places.offsets.to_numpy()[:-1], places.values.to_numpy()
            full = (batch["__i"].is_valid().to_numpy(zero_copy_only=False) & batch["__d"].is_valid().to_numpy(zero_copy_only=False))[order]
            i = np.where(full, batch["__i"].fill_null(0).to_numpy()[order], 0)
            d = np.where(full, batch["__d"].fill_null(0.0).to_numpy()[order], 0.0)
            none = np.add.reduceat(full.astype(np.int64), starts) == 0
            for a in range(0, len(wanted), CHUNK):
                own = wanted[a : a + CHUNK]
                angle = 2 * math.pi * (np.outer(i, own) % n) / n
                re, im = (np.add.reduceat(d[:, None] * f(angle), starts, axis=0).ravel() for f in (np.cos, np.sin))
                mask, again = np.repeat(none, len(own)), pa.array(np.repeat(np.arange(len(starts)), len(own)))
                yield pa.RecordBatch.from_arrays(
                    [*(keys[b].combine_chunks().take(again) for b in by), pa.array(np.tile(own, len(starts)), pa.int32()), pa.array(re, mask=mask), pa.array(-im, mask=mask)], names=schema.names
                )

    parts = rows.mapInArrow(sums, schema).groupBy(*by, "bin").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return parts.withColumn("mag", magnitude(F.col("re"), F.col("im")))


def band_join(spectrum: DataFrame, windows: DataFrame) -> DataFrame:
    """Each spectrum row once for every band that holds its bin: the small grid is expanded, never the spectrum."""
    members = windows.select("k", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("bin"))
    return spectrum.join(F.broadcast(members), "bin")


def sample_bins(spectrum: DataFrame, grid: DataFrame) -> DataFrame:
    """The spectrum at each grid point's own bin."""
    return spectrum.join(F.broadcast(grid.select("k", "bin")), "bin")


def band_features(spectrum: DataFrame, windows: DataFrame, by: Sequence[str] = ("chip",)) -> DataFrame:
    """``by, k, v``: the root mean square of each band of a long spectrum, as parts of a unit vector."""
    rms = band_join(spectrum, windows).groupBy(*by, "k").agg(F.sqrt(F.avg(F.col("mag") * F.col("mag"))).alias("rms"))
    norm = F.sqrt(F.sum(F.col("rms") * F.col("rms")).over(Window.partitionBy(*by)))  # over a trace's bands
    return rms.select(*by, "k", (F.col("rms") / (norm + 1e-12)).alias("v"))


def features(traces: DataFrame, lo: Sequence[int], hi: Sequence[int], bins: Sequence[int], samples: str = "samples") -> DataFrame:
    """``traces`` without their samples, with ``ev_band``, ``ev_bin`` and ``raw_energy``.

    One transform of each trace serves both methods.  Null samples count as 0 and a null or empty trace has
    null features; a trace shorter than twice the last band is an error of its caller.
    """
    low, high, at = (np.asarray(x, np.int64) for x in (lo, hi, bins))
    kept = [f for f in traces.schema.fields if f.name not in (samples, "ev_band", "ev_bin", "raw_energy")]
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([*kept, T.StructField("ev_band", vector), T.StructField("ev_bin", vector), T.StructField("raw_energy", T.DoubleType())])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch[samples]
            band, single, energy = [], [], []
            for k in range(batch.num_rows):
                if not column[k].is_valid or not len(column[k]):
                    band.append(None), single.append(None), energy.append(None)
                    continue
                values = np.nan_to_num(column[k].values.to_numpy(zero_copy_only=False).astype(float))
                mags = _kernels.spectrum(values)
                band.append(_kernels.unit(_kernels.band_rms(mags, low, high)))
                single.append(_kernels.unit(mags[at]))
                energy.append(float((mags**2).sum()))
            out = [batch[f.name] for f in kept]
            out += [pa.array(band, pa.list_(pa.float64())), pa.array(single, pa.list_(pa.float64())), pa.array(energy, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return traces.select(*[f.name for f in kept], samples).mapInArrow(transform, schema)


def assemble(samples: DataFrame, by: Sequence[str] = ("chip", "label"), index: str = "i", value: str = "d") -> DataFrame:
    """Long samples as one array for each trace, in the order of their index."""
    pairs = F.array_sort(F.collect_list(F.struct(index, value)))
    return samples.groupBy(*by).agg(F.transform(pairs, lambda x: x[value]).alias("samples"))
