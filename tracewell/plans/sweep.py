"""Robustness sweeps over noise and clock drift, and evaluation by threat class."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import _kernels
from tracewell.operators.cluster import _keys
from tracewell.operators.detect import Detector, evaluate_all, fit_detector, score
from tracewell.operators.spectral import features
from tracewell.sources.shared import written

#: The two sweeps, fixed by the published experiment: signal-to-noise ratios at 0.5 % drift, drifts at 20 dB.
SNRS, SNR_DRIFT = (30.0, 25.0, 20.0, 15.0, 10.0, 5.0), 0.5
DRIFTS, DRIFT_SNR = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0), 20.0


def conditions() -> list[tuple[str, float, float]]:
    """``experiment, snr_db, drift_pct``."""
    return [("snr", s, SNR_DRIFT) for s in SNRS] + [("drift", DRIFT_SNR, d) for d in DRIFTS]


def condition_grid(chips: DataFrame, found: Sequence[tuple[str, float, float]] | None = None) -> DataFrame:
    """Every chip under every condition; the few conditions are broadcast."""
    conds = chips.sparkSession.createDataFrame(list(found or conditions()), "experiment string, snr_db double, drift_pct double")
    return chips.crossJoin(F.broadcast(conds))


def stressed(traces: DataFrame, seed: int, samples: str = "samples", chip: str = "chip") -> DataFrame:
    """Wide traces resampled by ``drift_pct`` and with noise at ``snr_db``; a trace's noise depends on its chip,
    condition and the seed alone.  Power is taken from the row's own samples, so nothing is shuffled."""

    def stress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                values = batch[samples][k].values.to_numpy(zero_copy_only=False).astype(float)
                drift, snr, key = batch["drift_pct"][k].as_py(), batch["snr_db"][k].as_py(), batch["__key"][k].as_py()
                place = np.arange(len(values)) * (1 + drift / 100)
                values = np.interp(place, np.arange(len(values)), values)
                sigma = np.sqrt(np.mean(values**2) / 10 ** (snr / 10))
                out.append(values + sigma * _kernels.keyed_normals(key, len(values)))
            columns = [pa.array(out, pa.list_(pa.float64())) if n == samples else batch[n] for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType(list(traces.schema.fields))
    keyed = traces.withColumn("__key", F.xxhash64(chip, "experiment", "snr_db", "drift_pct", F.lit(seed)))
    return keyed.mapInArrow(stress, schema)


def _evaluated(vectors: DataFrame, by: list[str], **fit) -> tuple[DataFrame, dict[str, Detector]]:
    detectors = fit_detector(vectors.where("split = 'train'"), by, **fit)
    verdicts = score(vectors.where("split = 'validation'"), detectors, by)
    return evaluate_all(verdicts, by), detectors


def robustness_sweep(traces: DataFrame, lo: Sequence[int], hi: Sequence[int], bins: Sequence[int], seed: int = 42) -> DataFrame:
    """One row of metrics for each condition and method; one transform of a trace serves both methods."""
    stress = stressed(condition_grid(traces), seed)
    methods = F.array(*(F.struct(F.lit(name).alias("method"), F.col(f"ev_{name}").alias("ev")) for name in ("band", "bin")))
    both = features(stress, lo, hi, bins).withColumn("__m", F.explode(methods)).select("*", "__m.*").drop("__m", "ev_band", "ev_bin")
    by = ["experiment", "snr_db", "drift_pct", "method"]
    return _evaluated(written(both, "sweep"), by, classes="label", tol=1e-5, max_iter=60)[0]


def threat_benchmark(vectors: DataFrame, by: str = "threat") -> DataFrame:
    """One row for each threat class: metrics, explained variance, and whether the modified cluster has more energy."""
    rows, detectors = _evaluated(written(vectors, "threats"), [by], classes="label", tol=1e-6, max_iter=60)
    extra = vectors.sparkSession.createDataFrame([(g, float(100 * d.pca.explained[: d.pca.coeff.shape[1]].sum()), bool(d.energy_higher), int(d.rounds)) for g, d in detectors.items()], "__grp string, explained_pct double, energy_higher boolean, n_iter int")
    return rows.withColumn("__grp", _keys(rows, [by])).join(F.broadcast(extra), "__grp").drop("__grp")
