from __future__ import annotations

import random
import time
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators.detect import fit_detector, score
from tracewell.operators.traces import hamming_toggles
from tracewell.plans import fixture
from tracewell.sources import publish_detectors
from tracewell.streaming import average_stream, keep_state_in_rocksdb, late_rows, ordered_toggles, read_verdicts, score_stream, toggles_stream, verdict_stream
from tracewell.streaming.ordered import OrderedLog


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert q.exception() is None


def test_verdicts_equal_batch(spark, sf_dir, tmp_path):
    traces = fixture.traces(spark, sf_dir).where("split = 'validation'")
    detectors = fit_detector(fixture.chip_vectors(spark, sf_dir).where("split = 'train'"))
    traces.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(traces.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(score_stream(stream, detectors, fixture.LO, fixture.HI, fixture.BINS), "verdicts", tmp_path)
    batch = score(fixture.chip_vectors(spark, sf_dir).where("split = 'validation'").drop("ev_bin"), detectors)
    pick = lambda df: {r.chip: (r.predicted, round(r.r_fd, 9)) for r in df.collect()}
    assert pick(spark.table("verdicts")) == pick(batch)


def test_toggles_over_batches_equal_window(spark, tmp_path):
    rows = [("a", i, (i * 2654435761) % 1000) for i in range(1, 41)] + [("b", i, i * i) for i in range(1, 11)]
    log = spark.createDataFrame(rows, "core string, cycle long, state long")
    for k, part in enumerate((log.where("cycle <= 17"), log.where("cycle > 17"), spark.createDataFrame([("a", 3, 5)], log.schema))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p={k}"))
    files = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run(toggles_stream(files, None), "toggles", tmp_path)  # with a timeout the job would wait for it without end
    got = spark.table("toggles").collect()
    late = [r for r in got if r.late]
    assert [(r.core, r.cycle, r.toggles) for r in late] == [("a", 3, None)]
    batch = {(r.core, r.cycle): r.toggles for r in hamming_toggles(log, ["core"], ["cycle"], ["state"]).collect()}
    assert {(r.core, r.cycle): r.toggles for r in got if not r.late} == batch


def by_batch(log, path, order):
    """The rows of a log as a file for each batch, rows in the given order."""
    for k, part in enumerate(order):
        log.sparkSession.createDataFrame(part, log.schema).coalesce(1).write.parquet(str(path / f"in/p={k}"))
    return log.sparkSession.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path / "in"))


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keep_state_in_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_shuffled_arrival_gives_the_toggles_of_the_batch(spark, tmp_path, rocksdb):
    rng = random.Random(3)
    rows = [(core, i, rng.getrandbits(62) * rng.choice([1, -1])) for core in "abc" for i in range(1, 31)]
    arrival = rows[:]
    rng.shuffle(arrival)
    cut = [arrival[:40], arrival[40:55], [*arrival[55:], ("a", 7, 5), ("b", 30, 1), ("b", None, 1), (None, 3, 1)]]  # two late ones, two that are no log
    log = spark.createDataFrame(rows, "core string, cycle long, state long")
    stream = ordered_toggles(by_batch(log, tmp_path, cut), delay_ms=None)
    q = stream.writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(200) and q.exception() is None
    got = spark.table("ordered").collect()
    batch = {(r.core, r.cycle): r.toggles for r in hamming_toggles(log, ["core"], ["cycle"], ["state"]).collect()}
    assert {(r.core, r.cycle): r.toggles for r in got if not r.late} == batch and len(got) == len(batch) + 2
    assert sorted((r.core, r.cycle, r.toggles) for r in got if r.late) == [("a", 7, None), ("b", 30, None)]
    assert late_rows(q.recentProgress) == 2


def test_timer_releases_rows(spark, tmp_path, rocksdb):
    """A running query: row 2 never comes, so rows 3 and 4 are passed on after the delay."""
    log = spark.createDataFrame([("a", 1, 1), ("a", 4, 0), ("a", 3, 7)], "core string, cycle long, state long")
    stream = ordered_toggles(by_batch(log, tmp_path, [log.collect()]), delay_ms=2_000)
    q = stream.writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        ends = time.time() + 90
        while spark.table("timed").count() < 3 and time.time() < ends:
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted((r.cycle, r.toggles, r.late) for r in spark.table("timed").collect()) == [(1, 1, False), (3, 2, False), (4, 3, False)]


class Clock:
    """A processor's state in memory, and its timers."""

    def __init__(self):
        self.states, self.timers, self.now = {}, [], 0

    def getValueState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Cell())

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


class Cell:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


def test_rows_wait_no_longer_than_the_delay():
    clock, log = Clock(), OrderedLog(100, 1, None)
    log.init(clock)

    def arrive(now, *rows):
        clock.now = now
        (out,) = log.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["cycle", "state"])]), clock)
        return [(c, None if x else int(t), bool(x)) for c, t, x in zip(out["cycle"], out["toggles"], out["late"], strict=True)]

    assert arrive(0, (1, 1), (3, 7), (4, 0)) == [(1, 1, False)] and clock.timers == [100]
    assert arrive(50, (6, 1)) == [] and clock.timers[-1] == 100
    clock.now = 100
    (out,) = log.handleExpiredTimer(("a",), clock, None)
    assert out["cycle"].tolist() == [3, 4] and out["toggles"].tolist() == [2, 3] and clock.timers[-1] == 150
    assert arrive(120, (2, 9), (5, 3)) == [(5, 2, False), (6, 1, False), (2, None, True)]
    assert arrive(130, (7, -1), (7, 5)) == [(7, 63, False), (7, None, True)] and not clock.states["waiting"].exists()


def scored(spark, tmp_path, stream):
    q = verdict_stream(stream, str(tmp_path / "models"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), fixture.LO, fixture.HI, fixture.BINS, available_now=True)
    assert q.awaitTermination(200) and q.exception() is None
    return read_verdicts(spark, str(tmp_path / "out")).collect()


def test_replayed_batch_keeps_its_model(spark, sf_dir, tmp_path):
    traces = fixture.traces(spark, sf_dir).where("split = 'validation'").cache()
    vectors = fixture.chip_vectors(spark, sf_dir)
    first = fit_detector(vectors.where("split = 'train'"))
    second = {g: replace(d, golden=d.modified, modified=d.golden, golden_pc=d.modified_pc, modified_pc=d.golden_pc, inverse_g=d.inverse_t, inverse_t=d.inverse_g) for g, d in first.items()}
    chips = sorted(r.chip for r in traces.select("chip").collect())
    half = chips[len(chips) // 2]
    traces.where(F.col("chip") < half).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(traces.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="no model"):
        scored(spark, tmp_path, stream)
    assert publish_detectors(spark, first, str(tmp_path / "models")) == 1
    assert {r.version for r in scored(spark, tmp_path, stream)} == {1}
    assert publish_detectors(spark, second, str(tmp_path / "models")) == 2
    traces.where(F.col("chip") >= half).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    before = scored(spark, tmp_path, stream)
    assert {(r.chip >= half, r.version) for r in before} == {(False, 1), (True, 2)}
    assert all((r.predicted == r.label) == (r.version == 1) for r in before)
    # Stopped between the sink and the end of the batch, and a new model came meanwhile.
    last = max((tmp_path / "checkpoint/progress/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert publish_detectors(spark, first, str(tmp_path / "models")) == 3
    after = scored(spark, tmp_path, stream)
    assert sorted(r.chip for r in after) == chips and sorted(map(str, after)) == sorted(map(str, before))
    traces.unpersist()


def test_running_average(spark, tmp_path):
    rows = [("x", f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 50, 10)] + [("x", "2024-01-01 03:00:00", 1.0)]
    events = spark.createDataFrame(rows, "kind string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run(average_stream(stream, ["kind"], "value"), "averages", tmp_path)
    got = {(r.window_start, r.kind): (r.mean_value, r.n) for r in spark.table("averages").collect()}
    batch = {(r.window_start, r.kind): (r.mean_value, r.n) for r in average_stream(events, ["kind"], "value").collect()}
    assert got and got.items() <= batch.items()
