"""Structured Streaming jobs: verdicts for new devices, toggles of a continuous log, running averages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators.detect import Detector, score
from tracewell.operators.spectral import features
from tracewell.streaming.ordered import TOGGLES, toggles_of

#: Of the cores of a bucket: their last cycles and states, and when they last sent something.
STATE = "cores array<string>, cycles array<long>, states array<long>, seen array<long>"
#: Buckets of cores; a call of Python and a state for each core would take a millisecond for each.
BUCKETS = 1024


def score_stream(stream: DataFrame, detectors: dict[str, Detector], lo: Sequence[int], hi: Sequence[int], bins: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Verdicts for newly measured traces against a frozen model; stateless, for append mode."""
    vectors = features(stream, lo, hi, bins).withColumnRenamed("ev_band", "ev").drop("ev_bin")
    return score(vectors, detectors, by)


def toggles_stream(stream: DataFrame, idle_timeout_ms: int | None = 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """``core, cycle, state, toggles, late`` of a continuous log of ``core, cycle, state``.

    The state of a core is its last cycle and state; rows of a batch are put in cycle order.  A row whose cycle
    isn't after the last one is late: it has null toggles and doesn't change the state.  A core that sends
    nothing for ``idle_timeout_ms`` starts from state 0 again; with None states stay, which a job that ends with its
    input (``availableNow``) needs, as waiting for timeouts never ends.

    Cores are dealt out to ``buckets``, and a bucket's rows of a batch are worked on together.  A bucket that gets rows
    writes the state of all its cores, some 40 bytes each: give more buckets to logs of more than some ten million cores.  A
    stream that goes on from a checkpoint keeps its number.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = 0 if idle_timeout_ms is None else state.getCurrentProcessingTimeMs()
        cores, *known = state.get if state.exists else ([], [], [], [])
        cores, known = np.array(cores, object), np.array(known, np.int64).reshape(3, -1)
        if idle_timeout_ms is not None:
            awake = known[2] + idle_timeout_ms > now
            cores, known = cores[awake], known[:, awake]
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            codes, cores = pd.factorize(np.concatenate([cores, rows["core"].to_numpy(object)]))
            kept = known.shape[1]  # these codes are 0, 1, ...
            fresh = np.array([[-(1 << 62)], [0], [now]], np.int64)
            known = np.concatenate([known, np.repeat(fresh, len(cores) - kept, axis=1)], axis=1)
            codes, cycle, value = codes[kept:], rows["cycle"].to_numpy(np.int64), rows["state"].to_numpy(np.int64)
            order = np.lexsort((cycle, codes))  # stable: of equal cycles the one that came first
            codes, cycle, value = codes[order], cycle[order], value[order]
            before = np.where(_first(codes), known[0, codes], np.maximum(known[0, codes], np.concatenate([cycle[:1], cycle[:-1]])))
            late = cycle <= before
            toggles = np.zeros(len(codes), np.int32)
            c, good = codes[~late], value[~late]
            toggles[~late] = toggles_of(good, np.where(_first(c), known[1, c], np.concatenate([good[:1], good[:-1]])))
            ends = _first(c[::-1])[::-1]
            known[0, c[ends]], known[1, c[ends]], known[2, codes] = cycle[~late][ends], good[ends], now
            yield pd.DataFrame({"core": cores[codes], "cycle": cycle, "state": value, "toggles": pd.arrays.IntegerArray(toggles, late.copy()), "late": late})
        if not len(cores):
            state.remove()
            return
        state.update((cores.tolist(), *known.tolist()))
        if idle_timeout_ms is not None:
            state.setTimeoutDuration(max(1, int(known[2].min()) + idle_timeout_ms - now))

    clean = stream.select(F.col("core").cast("string").alias("core"), F.col("cycle").cast("long").alias("cycle"), F.coalesce(F.col("state").cast("long"), F.lit(0).cast("long")).alias("state")).where("core is not null and cycle is not null")
    dealt = clean.withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, TOGGLES, STATE, "append", GroupStateTimeout.NoTimeout if idle_timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def _first(codes: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its code; rows of a code lie together."""
    return np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]])


def average_stream(stream: DataFrame, by: Sequence[str], value: str, window: str = "1 hour", watermark: str = "10 minutes", time: str = "ts") -> DataFrame:
    """``window_start, by, mean_value, n`` over tumbling windows; rows behind the watermark are left out.

    On a batch frame the watermark means nothing and every row counts.  A stream's times without a zone are taken in the
    session's, as watermarks need one.
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark) if stream.isStreaming else stream
    found = rows.groupBy(F.window(time, window), *by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    return found.select(F.col("window.start").alias("window_start"), *by, "mean_value", "n")
