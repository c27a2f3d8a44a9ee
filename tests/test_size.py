"""What grows with the tables: shuffles, repeated work and memory of tasks."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import detect, spectral
from tracewell.operators.cluster import fcm_fit, with_memberships
from tracewell.operators.subspace import pca_fit, pca_project
from tracewell.operators.traces import hamming_toggles
from tracewell.plans import fixture
from tracewell.queries import QUERIES
from tracewell.sources import cycle_logs
from tracewell.streaming import toggles_stream


def plan_of(df) -> str:
    """The physical plan before it runs, and with any table too large to be broadcast at run time."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bands_by_join_transform_samples_once(spark, sf_dir):
    plan = plan_of(QUERIES["ev_band_by_join"](spark, sf_dir))
    assert plan.count("events.parquet") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("block", [1 << 16, 32])
def test_selected_bins_repeat_no_sample(spark, monkeypatch, block):
    monkeypatch.setattr(spectral, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3, 100))
    rows = [(k, i, float(x[k, i])) for i in range(100) for k in range(3)] + [(0, None, 1.0), (0, 5, None), (9, 1, None)]
    found = spectral.dft_bins(spark.createDataFrame(rows, "chip long, i int, d double"), [0, 7, 49], 100)
    assert "NestedLoopJoin" not in plan_of(found) and "CartesianProduct" not in plan_of(found)
    got = {(r.chip, r.bin): r for r in found.collect()}
    assert len(got) == 12 and all(got[9, b].re is None and got[9, b].mag is None for b in (0, 7, 49))
    for k, y in enumerate(np.fft.fft(x)):
        assert all(abs(complex(got[k, b].re, got[k, b].im) - y[b]) < 1e-9 for b in (0, 7, 49))


def test_samples_are_made_behind_the_shuffle(spark, sf_dir):
    """Sums of hours are shuffled, samples aren't; and no partition takes up what AQE would put together by the small sums."""
    for df in (fixture.samples(spark, sf_dir).groupBy("chip").agg(F.sum("d")), fixture.traces(spark, sf_dir)):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_toggles_of_many_cores_share_buckets(spark, tmp_path):
    """Four calls of Python a batch for 300 cores; cores of a bucket keep their own states, and late rows."""
    rows = [(f"c{k}", i, (k * 7919 + i * 2654435761) % (1 << 40)) for k in range(300) for i in range(1, 10)]
    log = spark.createDataFrame(rows, "core string, cycle long, state long")
    again = spark.createDataFrame([("c5", 3, 1), ("c6", 10, 2), ("c6", 10, 3), (None, 1, 1)], log.schema)
    for k, part in enumerate((log.where("cycle <= 4"), log.where("cycle > 4 and core != 'c9'"), again)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p={k}"))
    files = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = toggles_stream(files, None, buckets=4).writeStream.format("memory").queryName("many").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) == 4
    got = spark.table("many").collect()
    kept = log.where("core != 'c9' or cycle <= 4").unionByName(again.where("core = 'c6' and state = 2"))
    batch = {(r.core, r.cycle): r.toggles for r in hamming_toggles(kept, ["core"], ["cycle"], ["state"]).collect()}
    assert {(r.core, r.cycle): r.toggles for r in got if not r.late} == batch and len(got) == len(batch) + 2
    assert sorted((r.core, r.cycle, r.toggles) for r in got if r.late) == [("c5", 3, None), ("c6", 10, None)]


def test_only_silent_cores_of_a_bucket_begin_anew(spark, tmp_path):
    path, schema = tmp_path / "in", "core string, cycle long, state long"
    write = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    write(("a", 1, 7), ("b", 1, 7))
    q = toggles_stream(spark.readStream.schema(schema).parquet(str(path)), 4_000, buckets=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).start()

    def came(n):
        ends = time.time() + 60
        while spark.table("idle").count() < n and time.time() < ends:
            time.sleep(0.1)

    try:
        for k in range(2, 8):  # b sends something in time, a doesn't
            came(k)
            time.sleep(1)
            write(("b", k, 7))
        came(8)
        write(("a", 2, 7), ("b", 8, 6))
        came(10)
    finally:
        q.stop()
    got = {(r.core, r.cycle): r.toggles for r in spark.table("idle").collect()}
    assert got["a", 1] == got["a", 2] == got["b", 1] == 3 and got["b", 8] == 1 and all(got["b", k] == 0 for k in range(2, 8))


def test_detector_places_chips_by_one_function(spark):
    """Memberships and scores are those of the operators, by one process of Python for each task and not two."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, f"g{k % 2}", rng.normal(size=4).tolist() if k else None) for k in range(30)], "chip long, x string, ev array<double>").persist()
    model, pca = fcm_fit(df, by=["x"], max_iter=3), pca_fit(df, 2, ["x"])
    found = detect._placed(df, model, pca, ["x"], "ev")
    assert plan_of(found).count("ArrowEvalPython") == 1
    apart = pca_project(with_memberships(df, model, ["x"]), pca, ["x"])
    assert found.columns == apart.columns and sorted(found.collect()) == sorted(apart.collect())


def test_a_batch_of_a_log_is_small(tmp_path):
    lines = "".join(f"{k},{k * 10},{k % 7},0.5,1\n" for k in range(300_000))
    (tmp_path / "log_golden.csv").write_text("cycle,timestamp_ns,hamming_toggles,vccint_shunt_v,cipher_match\n" + lines)
    path = str(tmp_path / "log_golden.csv")
    batches = list(cycle_logs.rows_of(path, 0, 1 << 30, cycle_logs.CORE, path))
    assert sum(b.num_rows for b in batches) == 300_000 and max(b.num_rows for b in batches) < 80_000


def test_streamed_traces_are_made_once(spark, sf_dir, monkeypatch):
    made = []
    monkeypatch.setattr(fixture, "_hours", lambda *a, f=fixture._hours: made.append(1) or f(*a))
    assert QUERIES["stream_score"](spark, sf_dir).count() > 0 and made == [1]
