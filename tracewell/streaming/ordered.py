"""Toggles of a log whose rows arrive out of order: they wait for their predecessors, for a while."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TOGGLES = "core string, cycle long, state long, toggles int, late boolean"
#: What the state of such a processor is kept in.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The name of the counters that a query reports with its progress.
COUNTERS = "ordered_log"


def toggles_of(states: np.ndarray, before: int | np.ndarray) -> np.ndarray:
    """How many bits each state differs in from the one before it; ``before`` is that of the first one, or of each."""
    shifted = before if isinstance(before, np.ndarray) else np.concatenate([np.array([before], np.int64), states[:-1]])
    return np.bitwise_count((states ^ shifted).view(np.uint64)).astype(np.int32)


class OrderedLog(StatefulProcessor):
    """Of a core: the last cycle that was passed on, with its state, and the rows that wait.

    A row is passed on when its predecessor was, or when it has waited for ``delay_ms``; then those that waited before it in
    the order of cycles go, too.  A row whose cycle is not after the last one passed on is late.
    """

    def __init__(self, delay_ms: int | None, first_cycle: int, ttl_ms: int | None) -> None:
        self.delay_ms, self.first_cycle, self.ttl_ms = delay_ms, first_cycle, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "cycle long, state long", self.ttl_ms)
        self.waiting = handle.getListState("waiting", "cycle long, state long, since long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        now = 0 if self.delay_ms is None else timerValues.getCurrentProcessingTimeInMs()
        arrived = np.stack([new["cycle"].to_numpy(np.int64), new["state"].to_numpy(np.int64), np.full(len(new), now, np.int64)], axis=1)
        yield self.passed(key, arrived, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.passed(key, np.empty((0, 3), np.int64), timerValues.getCurrentProcessingTimeInMs())

    def passed(self, key: tuple, arrived: np.ndarray, now: int) -> pd.DataFrame:
        held = np.array(list(self.waiting.get()), np.int64).reshape(-1, 3) if self.waiting.exists() else np.empty((0, 3), np.int64)
        cycle, state = self.last.get() if self.last.exists() else (self.first_cycle - 1, 0)
        rows = np.concatenate([held, arrived])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]  # of equal cycles the one that came first
        again = np.concatenate([[False], rows[1:, 0] == rows[:-1, 0]]) if len(rows) else np.zeros(0, bool)
        late = (rows[:, 0] <= cycle) | again
        good, late = rows[~late], rows[late]
        # What follows the last cycle without a gap goes, and what has waited long enough, with all before it.
        ready = int(np.argmin(np.append(good[:, 0] == cycle + 1 + np.arange(len(good)), False)))
        overdue = np.flatnonzero(good[:, 2] + self.delay_ms <= now) if self.delay_ms is not None else np.empty(0, np.int64)
        if len(overdue) and overdue[-1] + 1 > ready:
            ready = int(overdue[-1]) + 1
            ready += int(np.argmin(np.append(good[ready:, 0] == good[ready - 1, 0] + 1 + np.arange(len(good) - ready), False)))
        out, rest = good[:ready], good[ready:]
        if len(out):
            self.last.update((int(out[-1, 0]), int(out[-1, 1])))
        if len(rest):
            self.waiting.put([tuple(map(int, r)) for r in rest])
            if self.delay_ms is not None:
                self.handle.registerTimer(int(rest[:, 2].min()) + self.delay_ms)
        elif len(held):
            self.waiting.clear()
        found = pd.DataFrame({"core": key[0], "cycle": np.concatenate([out[:, 0], late[:, 0]]), "state": np.concatenate([out[:, 1], late[:, 1]])})
        none = np.arange(len(found)) >= len(out)
        counts = np.concatenate([toggles_of(out[:, 1], state) if len(out) else np.empty(0, np.int32), np.zeros(len(late), np.int32)])
        found["toggles"] = pd.arrays.IntegerArray(counts.astype(np.int32), none.copy())
        found["late"] = none
        return found

    def close(self) -> None:
        pass


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that ``ordered_toggles`` needs; queries that run already keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def ordered_toggles(stream: DataFrame, delay_ms: int | None = 60_000, first_cycle: int = 1, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """``core, cycle, state, toggles, late`` of a log of ``core, cycle, state`` whose rows arrive in any order.

    Cycles of a core count up by one from ``first_cycle``.  Where one is missing, later ones wait for it, ``delay_ms`` at most
    by the clock; what comes after that is late, has null toggles and is counted, as ``late`` beside ``rows`` in the counters
    of the query's progress.  A core that is silent for ``ttl_ms`` is forgotten and begins anew (None: never).

    A job that ends with its input (``availableNow``) takes ``delay_ms=None``, since with timers it would wait without end: rows
    then wait for their predecessors alone, nothing is forgotten, and rows whose predecessor never came stay in the state.
    """
    clean = stream.select(F.col("core").cast("string").alias("core"), F.col("cycle").cast("long").alias("cycle"), F.coalesce(F.col("state").cast("long"), F.lit(0).cast("long")).alias("state")).where("core is not null and cycle is not null")
    timed = delay_ms is not None
    processor = OrderedLog(delay_ms, first_cycle, ttl_ms if timed else None)
    found = clean.groupBy("core").transformWithStateInPandas(processor, TOGGLES, "Append", "ProcessingTime" if timed else "None")
    return found.observe(COUNTERS, F.count("*").alias("rows"), F.count(F.when(F.col("late"), 1)).alias("late"))


def late_rows(progress: list) -> int:
    """How many late rows the progress reports of a query count."""
    return sum(p.observedMetrics[COUNTERS]["late"] for p in progress if COUNTERS in p.observedMetrics)
