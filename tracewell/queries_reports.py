"""Queries that write power, timing and utilization reports as files and parse them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.report_tables import path_delays, power_figures, report_cells, report_figures, timing_figures
from tracewell.operators.reports import overhead_verdict, report_overhead, sweep_report
from tracewell.queries_frequency import r6, table
from tracewell.sources import read_reports
from tracewell.sources.shared import new_path, written


def _right(value: Column | str, width: int) -> Column:
    return F.lpad(F.lit(value) if isinstance(value, str) else value, width, " ")


def _milli(value: Column) -> Column:
    """Thousandths as a decimal with three places."""
    whole, rest = F.floor(F.abs(value) / 1000), F.abs(value) % 1000
    return F.concat(F.when(value < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 3, "0"))


def _lines(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden and a modified design of each brand, from its even and odd parts: cells, registers, milliwatts and picoseconds."""
    part = table(spark, sf_dir, "part").where("p_brand is not null and p_partkey is not null")
    modified = (F.col("p_partkey") % 2 == 1).alias("modified")
    found = part.groupBy(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("device"), modified).agg(F.sum("p_size").cast("long").alias("luts"), F.count("*").alias("parts"))
    return found.select("device", "modified", F.concat("device", F.when(F.col("modified"), "_modified").otherwise("_golden")).alias("report"), "luts", (F.col("parts") * 11).alias("registers"), (F.col("luts") % 997).alias("mw"), (F.col("luts") % 9001 - 2000).alias("slack"))


def _power_text() -> Column:
    row = lambda name, power, used: F.concat(F.lit(f"| {name:<14} | "), _right(power, 9), F.lit(" | "), _right(used, 8), F.lit(" |"))
    frame, total = "+----------------+-----------+----------+", _milli(F.col("mw") + 70)
    summary = lambda name, value: F.concat(F.lit(f"| {name:<23} | "), F.rpad(value, 12, " "), F.lit(" |"))
    low = F.when(F.col("mw") % 2 == 0, F.lit("<0.001")).otherwise(_milli(F.col("mw")))
    return _lines(
        "-----", "| Design : x", "-----", "", "1. Summary", "----------", "", "+-------------------------+--------------+", summary("Total On-Chip Power (W)", total), summary("Power Budget Margin (W)", F.lit("NA")),
        summary("Dynamic (W)", _milli(F.col("mw"))), summary("Device Static (W)", F.lit("0.070")), "+-------------------------+--------------+", "* a note", "", "1.1 On-Chip Components", "----------------------", "",
        frame, row("On-Chip", "Power (W)", "Used"), frame, row("Slice Logic", low, F.col("luts").cast("string")), row("  Register", _milli(F.col("mw")), F.col("registers").cast("string")), row("Static Power", "0.070", ""), frame,
    )


def _timing_text() -> Column:
    """Slacks are right below their header's dashes, or begin before them."""
    box = lambda title: ["-" * 40, f"| {title}", "| " + "-" * len(title), "-" * 40, ""]
    endpoints = F.col("registers").cast("string")
    return _lines(
        *box("Design Timing Summary"), "    WNS(ns)      TNS(ns)  TNS Failing Endpoints  TNS Total Endpoints      WHS(ns)", "    -------      -------  ---------------------  -------------------      -------",
        F.concat(_right(_milli(F.col("slack")), 11), _right(_milli(F.least(F.lit(0), F.col("slack") * 1_000_000)), 13), _right("0", 23), _right(endpoints, 21), _right("0.134", 13)), "", "", *box("Clock Summary"),
        "Clock  Waveform(ns)       Period(ns)      Frequency(MHz)", "-----  ------------       ----------      --------------", "clk    {0.000 5.000}      10.000          100.000", "slow   {0.000 50.000}     100.000         10.000", "",
        "Max Delay Paths", "-" * 30, F.concat(F.when(F.col("slack") < 0, "Slack (VIOLATED) :").otherwise("Slack (MET) :"), F.lit("     "), _milli(F.col("slack")), F.lit("ns  (required time - arrival time)")),
        F.concat(F.lit("  Data Path Delay:        "), _milli(10_000 - F.col("slack")), F.lit("ns  (logic 0.875ns (39.115%)  route 1.362ns (60.885%))")), "  Logic Levels:           2  (LUT2=1 LUT6=1)",
    )


def _utilization_text() -> Column:
    row = lambda name, used: F.concat(F.lit(f"| {name:<15} | "), _right(used, 6), F.lit(" |     0 |"))
    frame = "+-----------------+--------+-------+"
    return _lines("1. Slice Logic", "--------------", "", frame, "| Site Type       |   Used | Fixed |", frame, row("Slice LUTs*", F.col("luts").cast("string")), row("Slice Registers", F.col("registers").cast("string")), frame)


def _written_reports(spark: SparkSession, sf_dir: str, *kinds: str) -> tuple[DataFrame, ...]:
    texts = {"power": _power_text(), "timing": _timing_text(), "utilization": _utilization_text()}
    path = new_path(spark, "reports")
    designs = _designs(spark, sf_dir)
    for kind in kinds:
        designs.select("report", texts[kind].alias("value")).write.partitionBy("report").text(f"{path}/{kind}")
    return tuple(read_reports(spark, f"{path}/{kind}", name=r"report=([^/]+)/") for kind in kinds)


def q_power_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the power tables of each design."""
    (reports,) = _written_reports(spark, sf_dir, "power")
    cells = report_cells(reports).where("k > 0")
    return cells.select("report_id", "section", "item", "column", "text", r6("value").alias("value"), "below")


def q_power_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    (reports,) = _written_reports(spark, sf_dir, "power")
    return power_figures(reports).select("report_id", *(r6(c).alias(c) for c in ("total_w", "dynamic_w", "static_w")), "dynamic_below")


def q_timing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slacks, endpoints, the fastest clock, and the worst path of each design."""
    (reports,) = _written_reports(spark, sf_dir, "timing")
    both = timing_figures(reports).join(path_delays(reports), "report_id")
    return both.select("report_id", *(r6(c).alias(c) for c in ("wns_ns", "tns_ns", "whs_ns", "period_ns", "fmax_mhz", "slack_ns", "delay_ns")), "endpoints", "section", "met", "levels")


def q_report_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the modified design of each device costs, and whether it passes, from parsed files alone."""
    power, timing, utilization = _written_reports(spark, sf_dir, "power", "timing", "utilization")
    figures = report_figures(utilization, power, timing).select(F.regexp_extract("report_id", "^(.*)_(golden|modified)$", 1).alias("device"), F.regexp_extract("report_id", "_(golden|modified)$", 1).alias("kind"), "item", "used")
    figures = written(figures, "figures")  # used three times
    overheads = report_overhead(figures.where("kind = 'golden'"), figures.where("kind = 'modified'"))
    delay = overheads.where("item = 'Critical path (ns)'").select("device", F.col("delta_pct").alias("delay_pct"))
    found = overhead_verdict(overheads, "Slice LUTs*", "Dynamic (W)", lut_limit=10.0, power_limit=40.0).join(delay, "device")
    return found.select("device", *(r6(c).alias(c) for c in ("lut_pct", "power_pct", "delay_pct")), "unnoticed")


def q_sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of orders as a published sweep (experiments are statuses, conditions years, methods priorities), read back from its JSON."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    rows = orders.groupBy(F.col("o_orderstatus").alias("experiment"), F.year("o_orderdate").alias("year"), F.substring("o_orderpriority", 1, 1).alias("method")).agg(F.count("*").alias("n"), r6(F.avg("o_totalprice")).alias("mean"))
    reports = sweep_report(rows, "experiment", "year", "method", ["n", "mean"])
    parsed = F.from_json("report", "conditions array<int>, methods map<string, struct<n: array<long>, mean: array<double>>>")
    found = reports.select("experiment", parsed.alias("r")).select("experiment", "r.conditions", F.explode("r.methods").alias("method", "m"))
    cells = F.explode(F.arrays_zip(F.col("conditions").alias("year"), F.col("m.n").alias("n"), F.col("m.mean").alias("mean")))
    return found.select("experiment", "method", cells.alias("c")).select("experiment", "method", "c.year", "c.n", "c.mean")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
_DESIGNS = """ds AS (
  SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS device, p_partkey % 2 = 1 AS modified, CAST(sum(p_size) AS BIGINT) AS luts, count(*) * 11 AS registers FROM part WHERE p_brand IS NOT NULL AND p_partkey IS NOT NULL GROUP BY 1, 2
),
de AS (SELECT device, modified, device || CASE WHEN modified THEN '_modified' ELSE '_golden' END AS report_id, luts, registers, luts % 997 AS mw, luts % 9001 - 2000 AS slack FROM ds)"""


def _text(milli: str) -> str:
    return f"CASE WHEN {milli} < 0 THEN '-' ELSE '' END || CAST(abs({milli}) // 1000 AS VARCHAR) || '.' || lpad(CAST(abs({milli}) % 1000 AS VARCHAR), 3, '0')"


def _cell(section: str, item: str, column: str, text: str, value: str, below: str = "false") -> str:
    name = f"'{column}'" if column else "NULL"
    return f"SELECT report_id, '{section}' AS section, '{item}' AS item, {name} AS \"column\", {text} AS text, CAST({value} AS DOUBLE) AS value, {below} AS below FROM de"


_CELLS = [
    _cell("1. Summary", "Total On-Chip Power (W)", "", _text("mw + 70"), "round((mw + 70) / 1000e0, 6)"), _cell("1. Summary", "Power Budget Margin (W)", "", "'NA'", "NULL"), _cell("1. Summary", "Dynamic (W)", "", _text("mw"), "round(mw / 1000e0, 6)"),
    _cell("1. Summary", "Device Static (W)", "", "'0.070'", "0.07e0"),
    _cell("1.1 On-Chip Components", "Slice Logic", "Power (W)", f"CASE WHEN mw % 2 = 0 THEN '<0.001' ELSE {_text('mw')} END", "CASE WHEN mw % 2 = 0 THEN 0.001e0 ELSE round(mw / 1000e0, 6) END", "mw % 2 = 0"),
    _cell("1.1 On-Chip Components", "Slice Logic", "Used", "CAST(luts AS VARCHAR)", "luts"), _cell("1.1 On-Chip Components", "Register", "Power (W)", _text("mw"), "round(mw / 1000e0, 6)"),
    _cell("1.1 On-Chip Components", "Register", "Used", "CAST(registers AS VARCHAR)", "registers"), _cell("1.1 On-Chip Components", "Static Power", "Power (W)", "'0.070'", "0.07e0"), _cell("1.1 On-Chip Components", "Static Power", "Used", "''", "NULL"),
]
ORACLE_SQL = {
    "sweep_report": """WITH r AS (SELECT o_orderstatus AS experiment, CAST(year(o_orderdate) AS INTEGER) AS y, substr(o_orderpriority, 1, 1) AS method, count(*) AS n, round(avg(o_totalprice), 6) + 0e0 AS mean FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT DISTINCT experiment, y FROM r), m AS (SELECT DISTINCT experiment, method FROM r)
SELECT c.experiment AS experiment, m.method AS method, c.y AS year, n, mean FROM c JOIN m ON c.experiment = m.experiment LEFT JOIN r ON r.experiment = c.experiment AND r.y = c.y AND r.method = m.method""",
    "power_reports": f"WITH {_DESIGNS} " + " UNION ALL ".join(_CELLS),
    "power_figures": f"WITH {_DESIGNS} SELECT report_id, round((mw + 70) / 1000e0, 6) AS total_w, round(mw / 1000e0, 6) + 0e0 AS dynamic_w, 0.07e0 AS static_w, false AS dynamic_below FROM de",
    "timing_reports": f"""WITH {_DESIGNS} SELECT report_id, round(slack / 1000e0, 6) + 0e0 AS wns_ns, least(0e0, slack * 1000e0) + 0e0 AS tns_ns, 0.134e0 AS whs_ns, 10e0 AS period_ns, round(1000e0 / (10e0 - slack / 1000e0), 6) AS fmax_mhz,
  round(slack / 1000e0, 6) + 0e0 AS slack_ns, round((10000 - slack) / 1000e0, 6) AS delay_ns, registers AS endpoints, 'Max Delay Paths' AS section, slack >= 0 AS met, 2 AS levels FROM de""",
    "report_verdict": f"""WITH {_DESIGNS}, p AS (
  SELECT g.device AS device, 100e0 * (t.luts - g.luts) / g.luts AS l, CASE WHEN g.mw > 0 THEN 100e0 * (t.mw - g.mw) / g.mw END AS w, t.mw - g.mw AS d, 100e0 * (g.slack - t.slack) / (10000 - g.slack) AS y FROM de g JOIN de t ON g.device = t.device WHERE t.modified AND NOT g.modified
)
SELECT device, round(l, 6) + 0e0 AS lut_pct, round(w, 6) + 0e0 AS power_pct, round(y, 6) + 0e0 AS delay_pct, l <= 10e0 AND coalesce(w <= 40e0, d <= 0) AS unnoticed FROM p""",
}
