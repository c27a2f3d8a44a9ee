from __future__ import annotations

from tracewell.operators.report_tables import path_delays, power_figures, report_cells, report_figures, report_lines, report_pairs, timing_figures

FRAMED = """Power Report

1. Summary
----------

+---------------------+--------------+
| Total On-Chip Power (W) | 4.630 |
| Dynamic (W) | <0.001 |
+---------------------+--------------+
* a note

1.1 Parts
---------

+-------+-----------+---------------+
| Name  | Power (W) | Details       |
+-------+-----------+---------------+
| a     |    -0.005 | x | y         |
|   b   |       NA  |               |
| c     |     1e-3  | 12.5 %        |
+-------+-----------+---------------+
"""
PLAIN = """--------------------
| Design Timing Summary
| ---------------------
--------------------

    WNS(ns)      TNS(ns)  TNS Total Endpoints
    -------      -------  -------------------
-123456.789 -9876543.210                  528


Clock  Waveform(ns)       Period(ns)
-----  ------------       ----------
clk    {0.000 500.000}    1000.000
fast   {0.000 5.000}      10.000

Max Delay Paths
---------------
Slack (VIOLATED) :        -2.5ns  (required time - arrival time)
  Data Path Delay:        2.237ns  (logic 0.875ns)
  Logic Levels:           3  (LUT2=1)
Slack (MET) :             0ns
  Data Path Delay:        1 ns
Min Delay Paths
---------------
Slack (MET) :             0.134ns
"""


def frame(spark, **reports):
    return spark.createDataFrame(list(reports.items()), "report_id string, value string")


def test_framed_tables(spark):
    rows = report_cells(frame(spark, p=FRAMED)).collect()
    cells = {(r.section, r.item, r.k): r for r in rows}
    assert len(rows) == 4 + 9 and {r.column for r in rows if r.section == "1. Summary"} == {None}
    assert cells["1. Summary", "Dynamic (W)", 1].value == 0.001 and cells["1. Summary", "Dynamic (W)", 1].below  # laid out by bars alone
    assert cells["1.1 Parts", "a", 2].text == "x | y" and cells["1.1 Parts", "a", 1].value == -0.005
    assert cells["1.1 Parts", "b", 1].value is None and cells["1.1 Parts", "b", 2].text == ""
    assert cells["1.1 Parts", "c", 1].value == 0.001 and cells["1.1 Parts", "c", 2].value == 12.5 and cells["1.1 Parts", "c", 1].column == "Power (W)"
    row = power_figures(frame(spark, p=FRAMED)).first()
    assert (row.total_w, row.dynamic_w, row.static_w, row.dynamic_below) == (4.63, 0.001, None, True)


def test_plain_tables(spark):
    cells = {(r.section, r.item, r.column): r.text for r in report_cells(frame(spark, t=PLAIN)).collect()}
    first = "-123456.789"
    assert cells["Design Timing Summary", first, "TNS(ns)"] == "-9876543.210" and cells["Design Timing Summary", first, "TNS Total Endpoints"] == "528"
    assert cells["Design Timing Summary", "clk", "Waveform(ns)"] == "{0.000 500.000}"
    assert cells["Design Timing Summary", "fast", "Period(ns)"] == "10.000"


def test_timing_paths(spark):
    text = PLAIN.replace("Clock  Waveform", "Clock Summary\n-------------\n\nClock  Waveform")
    row = timing_figures(frame(spark, t=text)).first()
    assert (row.wns_ns, row.tns_ns, row.whs_ns, row.endpoints, row.period_ns) == (-123456.789, -9876543.21, None, 528, 10.0)
    assert abs(row.fmax_mhz - 1000 / 123466.789) < 1e-12
    paths = {r.path: tuple(r)[2:] for r in path_delays(frame(spark, t=text)).collect()}
    assert paths == {1: ("Max Delay Paths", -2.5, False, 2.237, 3), 2: ("Max Delay Paths", 0.0, True, 1.0, None), 3: ("Min Delay Paths", 0.134, True, None, None)}
    units = {r.item: r.unit for r in report_pairs(frame(spark, t=text)).where("path = 1").collect()}
    assert units == {"Slack (VIOLATED)": "ns", "Data Path Delay": "ns", "Logic Levels": None}


def test_odd_reports(spark):
    odd = frame(spark, null=None, empty="", words="no table\n- here", rule="+---+\n+---+", bars="| a | b |\r\n", crlf=FRAMED.replace("\n", "\r\n"))
    assert {r.report_id for r in report_cells(odd).collect()} == {"crlf"}
    assert report_lines(odd).where("report_id = 'crlf' and section = '1.1 Parts'").count() == report_lines(frame(spark, p=FRAMED)).where("section = '1.1 Parts'").count()
    assert timing_figures(odd).count() == 0 and {r.report_id for r in power_figures(odd).collect()} == {"crlf"}
    assert report_figures(odd, odd, odd).count() == 1 and path_delays(odd).count() == 0


def test_sweep_report(spark):
    import json

    from tracewell.operators.reports import sweep_report

    rows = spark.createDataFrame([("snr", 10.0, "bin", 50.0, 1.5), ("snr", 5.0, "bin", 45.0, None), ("snr", 10.0, "band", 100.0, 9.0), ("drift", 0.5, "bin", 1.0, 2.0), ("drift", 0.5, "bin", 1.0, 1.0), ("drift", None, "bin", 9.0, 9.0), ("drift", 0.5, None, 3.0, None)], "experiment string, snr_db double, method string, accuracy double, margin double")
    found = {r.experiment: json.loads(r.report) for r in sweep_report(rows, "experiment", "snr_db", "method", ["accuracy", "margin"]).collect()}
    assert found["snr"] == {"conditions": [5.0, 10.0], "methods": {"band": {"accuracy": [None, 100.0], "margin": [None, 9.0]}, "bin": {"accuracy": [45.0, 50.0], "margin": [None, 1.5]}}}
    assert found["drift"]["methods"] == {"bin": {"accuracy": [1.0], "margin": [2.0]}, "": {"accuracy": [3.0], "margin": [None]}}
    assert sweep_report(rows.limit(0), "experiment", "snr_db", "method", ["accuracy"]).count() == 0
