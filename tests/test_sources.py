from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewell.functions import fmax_mhz
from tracewell.operators.reports import overhead_verdict, parse_pipe_tables, register_audit, report_overhead
from tracewell.sources import cycle_logs, read_chip_vectors, read_cycle_logs, read_reports, read_sources, write_report, write_traces
from tracewell.sources.buckets import bucket_count


def test_cycle_logs_of_both_headers(spark, tmp_path):
    (tmp_path / "log_golden.csv").write_text("cycle,timestamp_ns,hamming_toggles,vccint_shunt_v,cipher_match\n" + "".join(f"{i},{50 + 100 * i},{i % 5},0.008500,1\n" for i in range(1, 9)))
    (tmp_path / "log_trojan.csv").write_text("cycle,timestamp_ns,hamming_toggles,vccint_shunt_mv,trojan_active\n" + "".join(f"{i},{50 + 100 * i},{i % 5},8.535,x\n" for i in range(1, 8)))
    (tmp_path / "log_stub.csv").write_text("cycle,timestamp_ns\n")
    rows = read_cycle_logs(spark, str(tmp_path / "*.csv")).collect()
    assert sorted({r.core for r in rows}) == ["golden", "trojan"] and len(rows) == 15
    g, t = next(r for r in rows if r.core == "golden"), next(r for r in rows if r.core == "trojan")
    assert g.vccint_shunt_v == 0.0085 and g.cipher_match == 1 and g.trojan_active is None
    assert abs(t.vccint_shunt_v - 0.008535) < 1e-12 and t.cipher_match is None and t.trojan_active is None


@pytest.mark.parametrize("range_bytes", [1, 7, 40, 131, 1 << 20])
def test_ranges_of_a_log_hold_each_line_once(tmp_path, monkeypatch, range_bytes):
    """Cut anywhere, also inside the header and beside line ends, with and without a last line end."""
    monkeypatch.setattr(cycle_logs, "READ_BYTES", 16)
    for name, end in (("log_a.csv", "\n"), ("log_b.csv", ""), ("log_c.csv", "\r\n\n")):
        lines = [f"{i},{i * 10**15},{i % 7},{i / 8},{'x' if i % 3 else 1}" for i in range(25)]
        (tmp_path / name).write_text("\n".join(["cycle,timestamp_ns,hamming_toggles, vccint_shunt_mv ,trojan_active", *lines]) + end)
    parts = cycle_logs.dealt(cycle_logs.listed(str(tmp_path), 100), range_bytes)
    assert all(sum(b - a for _, a, b in p.parts) <= range_bytes for p in parts)
    rows = [r for p in parts for path, a, b in p.parts for batch in cycle_logs.rows_of(path, a, b, cycle_logs.CORE, str(tmp_path)) for r in batch.to_pylist()]
    assert sorted((r["core"], r["cycle"]) for r in rows) == [(c, i) for c in "abc" for i in range(25)]
    assert all(r["timestamp_ns"] == r["cycle"] * 10**15 and r["vccint_shunt_v"] == r["cycle"] / 8000 and r["trojan_active"] == (None if r["cycle"] % 3 else 1) and r["cipher_match"] is None for r in rows)


def test_odd_fields_and_files(spark, tmp_path):
    head = "cycle,timestamp_ns,hamming_toggles,vccint_shunt_v,cipher_match\n"
    (tmp_path / "d").mkdir()
    (tmp_path / "d/log_x.csv").write_text(head + "1,2\n2147483648,9223372036854775807,+3,-.5,é\n 5 , 9223372036854775808 , 1.5 ,1e-3, 0 ,more\n\n" + head + "x,y,z,NaN,\n")
    (tmp_path / "log_empty.csv").write_text("")
    (tmp_path / "_hidden_y.csv").write_text(head + "1,1,1,1,1\n" * 30)
    rows = sorted(map(tuple, read_cycle_logs(spark, str(tmp_path)).collect()), key=str)
    assert rows == sorted([("x", 1, 2, None, None, None, None), ("x", None, 2**63 - 1, 3, -0.5, None, None), ("x", 5, None, None, 0.001, 0, None), ("x", None, None, None, None, None, None)], key=str)
    assert read_cycle_logs(spark, str(tmp_path / "nothing")).count() == 0
    assert read_cycle_logs(spark, f"file://{tmp_path}/d/*.csv").count() == 4


def test_streamed_logs_equal_batch_and_no_join(spark, tmp_path):
    head = "cycle,timestamp_ns,hamming_toggles,vccint_shunt_v,cipher_match\n"
    write = lambda core, n: (tmp_path / f"log_{core}.csv").write_text(head + "".join(f"{i},{i},{i % 5},0.5,1\n" for i in range(n)))

    def run():
        q = read_cycle_logs(spark, str(tmp_path / "*.csv"), stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    write("a", 40)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    write("b", 30), write("c", 20)
    run()
    run()
    batch = read_cycle_logs(spark, str(tmp_path / "*.csv"))
    assert sorted(map(tuple, spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_bucketed_logs_shuffle_nothing(spark, sf_dir):
    from tracewell.queries import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bucketed_toggles", "bucketed_differential"):
            found = QUERIES[name](spark, sf_dir)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
            assert ("Window" if name == "bucketed_toggles" else "SortMergeJoin") in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert bucket_count(0) == 1 and bucket_count(1 << 40) == 8192


def test_chip_vectors(spark, tmp_path):
    doc = {"n_samples": 10, "training_chips": [{"chip_id": "a", "label": 0, "ev": [1.0, 2.0]}], "validation_chips": [{"chip_id": "b", "ground_truth": 1, "category": "x", "ev": []}]}
    (tmp_path / "v.json").write_text(json.dumps(doc, indent=1))
    rows = {r.chip_id: r for r in read_chip_vectors(spark, str(tmp_path / "v.json")).collect()}
    assert rows["a"].split == "train" and rows["a"].ev == [1.0, 2.0] and rows["b"].label == 1 and rows["b"].category == "x"


def test_reports(spark, tmp_path):
    table = "+---+\n| Site Type | Used | Fixed |\n| Slice LUTs* |  {} |     0 |\n| Slice Registers | {} |\n"
    (tmp_path / "util_golden.txt").write_text(table.format(2000, 391))
    (tmp_path / "util_new.txt").write_text(table.format(2003, "n/a"))
    parsed = parse_pipe_tables(read_reports(spark, str(tmp_path / "*.txt")), ["Slice LUTs*", "Slice Registers"]).withColumn("device", F.lit("d"))
    of = lambda name: parsed.where(F.col("report_id") == name)
    rows = {r.item: r for r in report_overhead(of("util_golden"), of("util_new")).collect()}
    assert rows["Slice LUTs*"].delta == 3 and rows["Slice LUTs*"].within and rows["Slice Registers"].modified is None


def test_capacity(spark):
    golden = spark.createDataFrame([("d", "lut", 2000, 20800)], "device string, item string, used int, available int")
    row = report_overhead(golden, golden.withColumn("used", F.lit(2052)), available="available").first()
    assert row.capacity_pct == 0.25 and not row.within and golden.select(fmax_mhz(F.lit(8.0)).alias("f")).first().f == 125.0


def test_registers(spark, tmp_path):
    (tmp_path / "core.v").write_text("reg [127:0] state, key;\nreg [3:0] round;\n reg done;\nwire [3:0] x;\n")
    (tmp_path / "more.v").write_text(
        """module m(output reg [7:0] q, input clk, output reg ready);
// reg [9:0] commented;
/* reg old;
   reg older; */
reg signed [15:0] a = {8'd1, 8'd2}, b = f(a, 3);
reg [7:0] mem [0:255], one;
reg [W-1:0] wide; reg [0:(3)] odd; initial $display("reg [3:0] shown;");
reg
  [1:0] split_1
  , split_2;
wire register; always @(posedge clk) deg <= q;
endmodule
"""
    )
    rows = {(r.file, r.signal): r.width for r in register_audit(read_sources(spark, str(tmp_path / "*.v"))).collect()}
    assert {s: w for (f, s), w in rows.items() if f == "core.v"} == {"state": 128, "key": 128, "round": 4, "done": 1}
    assert {s: w for (f, s), w in rows.items() if f == "more.v"} == {"q": 8, "ready": 1, "a": 16, "b": 16, "mem": 2048, "one": 8, "wide": None, "odd": None, "split_1": 2, "split_2": 2}


def test_joint_verdict(spark):
    rows = [("a", "lut", 10_000, 10_015), ("a", "power", 1000, 1001), ("b", "lut", 10_000, 10_015), ("b", "power", 1000, 1002), ("c", "lut", 10_000, 10_016), ("c", "power", 1000, 1000), ("d", "lut", 0, 0), ("d", "power", 5, 5), ("e", "lut", 7, 7)]
    table = spark.createDataFrame(rows, "device string, item string, g int, t int")
    found = report_overhead(table.withColumnRenamed("g", "used"), table.withColumnRenamed("t", "used"))
    assert {r.device: r.unnoticed for r in overhead_verdict(found, "lut", "power").collect()} == {"a": True, "b": False, "c": False, "d": True, "e": None}


def test_sinks(spark, tmp_path):
    traces = spark.createDataFrame([("train", 1, [0.5]), ("validation", 2, [1.5])], "split string, chip int, samples array<double>")
    write_traces(traces, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("split = 'train'").select("chip").collect()[0][0] == 1
    write_report(traces.drop("samples"), str(tmp_path / "r"), as_json=True)
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_written_tables_are_released(spark, tmp_path):
    from tracewell.sources import shared

    shared.release(spark)
    first, second = shared.written(spark.range(5), "a"), shared.written(spark.range(7), "b")
    folder = shared.shared_folder(spark).removeprefix("file://")
    assert len(os.listdir(folder)) >= 2 and first.count() == 5
    assert shared.release(spark, keep=1) == 1 and second.count() == 7
    assert shared.release(spark) == 1 and shared.release(spark) == 0
    assert not [x for x in os.listdir(folder) if x.startswith(("a-", "b-"))]
