"""Queries on cycle logs, reports and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import active_flag, shunt_voltage
from tracewell.operators.cluster import semi_by_cluster
from tracewell.operators.reports import extra_signals, nested_report, overhead_verdict, parse_pipe_tables, register_audit, report_overhead
from tracewell.operators.traces import average_repeats, differential, hamming_toggles, low_toggle_patterns, parity_mismatches, toggle_summary
from tracewell.queries_frequency import r6, table
from tracewell.sources import assignment_map
from tracewell.streaming import average_stream

#: Line items as a state log: orders are runs, lines are cycles, parts are states; odd orders are the modified core.
LOG_SQL = """
lg AS (
  SELECT run, cycle, part, qty, kind, CAST(bit_count(xor(part, coalesce(lag(part) OVER (PARTITION BY run ORDER BY cycle, part, qty, price), 0))) AS INTEGER) AS plain, price
  FROM (SELECT l_orderkey AS run, l_linenumber AS cycle, l_partkey AS part, l_quantity AS qty, l_linestatus AS kind, l_extendedprice AS price FROM lineitem) z
),
tg AS (SELECT run, cycle, part, qty, price, kind, CAST(plain + CASE WHEN run % 2 = 1 AND kind = 'O' THEN 1 ELSE 0 END AS INTEGER) AS toggles FROM lg)"""


#: The order of a run's lines.
ORDER = ["cycle", "part", "qty", "price"]


def plain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("cycle"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_linestatus").alias("kind"))


def counter() -> F.Column:
    return F.when((F.col("run") % 2 == 1) & (F.col("kind") == "O"), 1).otherwise(0)


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_toggles(plain_log(spark, sf_dir), ["run"], ORDER, ["part"], counter())


def q_hamming_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_log(spark, sf_dir).select("run", "cycle", "part", "toggles")


def q_hamming_toggles_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toggles with the counter of the base design, of which the bits that change count; quantities are its states."""
    held = F.when(F.col("run") % 2 == 1, F.col("qty").cast("long")).otherwise(0)
    return hamming_toggles(plain_log(spark, sf_dir), ["run"], ORDER, ["part"], held, "base").select("run", "cycle", "part", "toggles")


def q_toggle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toggle_summary(state_log(spark, sf_dir), F.col("run") % 2 == 1)
    return found.select(*(r6(c).alias(c) for c in found.columns))


def q_low_toggle_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return low_toggle_patterns(state_log(spark, sf_dir), "part", "toggles", 10).select("part", F.col("total_toggles").cast("long").alias("total_toggles"))


def q_shunt_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    modified, active = F.col("run") % 2 == 1, active_flag(F.col("kind") == "O", F.col("qty").cast("int") % 10)
    log = state_log(spark, sf_dir).withColumn("active", active)
    volts = lambda v: r6(shunt_voltage(F.col("toggles"), modified, F.col("active") == 1, v))
    return log.select("run", "cycle", "part", "active", volts("main").alias("main_mv"), volts("base").alias("base_mv"))


def two_logs(spark: SparkSession, sf_dir: str, value: F.Column) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("out"))
    log = lambda odd: rows.where((F.col("l_linenumber") % 2 == 1) == F.lit(odd)).groupBy("l_orderkey").agg(F.max("out").alias("out"))
    return log(True), log(False)


def q_trace_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differential(*two_logs(spark, sf_dir, F.col("l_quantity")), ["l_orderkey"], "out")


def q_parity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return parity_mismatches(*two_logs(spark, sf_dir, status), ["l_orderkey"], "out")


def q_average_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    return average_repeats(rows, ["user_id", "event_type", "hour"], "value").select("user_id", "event_type", "hour", r6("mean_value").alias("mean_value"), "repeats")


def q_average_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the running average."""
    found = average_stream(table(spark, sf_dir, "events"), ["event_type"], "value", "6 hours")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", r6("mean_value").alias("mean_value"), "n")


def q_cluster_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    chips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chip"), "c_name")
    assigned = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chip"), F.substring("o_orderpriority", 1, 1).cast("int").alias("cluster"))
    return semi_by_cluster(chips, assigned, 1)


def q_cohort_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chip"), "c_mktsegment")
    return rows.where("chip % 2 = 0").withColumn("label", F.lit(0)).unionByName(rows.where("chip % 2 = 1").withColumn("label", F.lit(1)))


def q_assignment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("c_mktsegment").alias("assigned_cluster"), F.col("c_name").alias("ground_truth"), (F.col("c_acctbal") / 10000).alias("membership_golden"))
    texts = table(spark, sf_dir, "customer").select(F.to_json(F.create_map(F.col("c_custkey").cast("string"), one)).alias("doc"))
    rows = texts.select(F.explode(assignment_map(F.col("doc"))).alias("chip_id", "a"))
    return rows.select("chip_id", "a.assigned_cluster", "a.ground_truth", r6("a.membership_golden").alias("membership_golden"))


def _signals(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == odd).select(F.col("p_brand").alias("signal"), F.col("p_size").alias("width"))


def q_extra_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra_signals(_signals(spark, sf_dir, 1), _signals(spark, sf_dir, 0)).groupBy("signal", "width").agg(F.count("*").alias("n"))


def q_register_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a source with ranged, plain and commented declarations, and a memory of four words."""
    name = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "_")
    text = F.concat(F.lit("module m;\n  reg ["), F.col("p_size").cast("string"), F.lit(":0] "), name, F.lit("_q, "), name, F.lit("_d;\n  reg flag_"), F.col("p_partkey").cast("string"), F.lit(" = 1'b0;\n  // reg [7:0] old;\n  reg signed [3:0] mem_q [0:3];\nendmodule\n"))
    sources = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), text.alias("value"))
    return register_audit(sources).groupBy("file").agg(F.count("*").alias("signals"), F.sum("width").cast("long").alias("bits"), F.max("signal").alias("last_signal"))


def q_pipe_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda item, used: F.concat(F.lit(f"| {item} |  "), used.cast("string"), F.lit(" |     0 |     20800 |  1.30 |\n"))
    text = F.concat(F.lit("+---+\n| Site Type | Used | Fixed | Available | Util% |\n"), line("Slice LUTs*", F.col("p_size") * 7), line("  LUT as Logic", F.col("p_size")), line("Slice Registers", F.col("p_size") * 11), F.lit("+---+\n"))
    reports = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("report_id"), text.alias("value"))
    return parse_pipe_tables(reports, ["Slice LUTs*", "Slice Registers"])


def q_report_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("device"), F.col("p_type").alias("item"), "p_size")
    used = lambda odd: rows.where(F.col("p_partkey") % 2 == odd).groupBy("device", "item").agg(F.sum("p_size").alias("used"))
    return report_overhead(used(0), used(1)).select("device", "item", "golden", "modified", "delta", r6("delta_pct").alias("delta_pct"), "within")


def q_overhead_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as devices: retail prices in cents stand for LUTs, sizes for power; odd parts are the modified design."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("device"), F.round(F.col("p_retailprice") * 100).cast("long").alias("lut"), F.col("p_size").cast("long").alias("power"))
    rows = rows.unpivot(["id", "device"], ["lut", "power"], "item", "used")
    used = lambda odd: rows.where(F.col("id") % 2 == odd).groupBy("device", "item").agg(F.sum("used").alias("used"))
    found = overhead_verdict(report_overhead(used(0), used(1)), "lut", "power", lut_limit=10.0, power_limit=5.0)
    return found.select("device", r6("lut_pct").alias("lut_pct"), r6("power_pct").alias("power_pct"), "unnoticed")


def q_nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    metrics = rows.groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("chips"), r6(F.avg("c_acctbal")).alias("mean"))
    found = nested_report(metrics, ["n_regionkey"], ["n_nationkey"])
    rows = F.posexplode(F.from_json("report", "array<struct<n_nationkey int, chips long, mean double>>")).alias("pos", "r")
    return found.select("n_regionkey", "n", rows).select("n_regionkey", "n", "pos", "r.n_nationkey", "r.chips", "r.mean")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
ORACLE_SQL = {
    "hamming_toggles_base": """WITH z AS (SELECT l_orderkey AS run, l_linenumber AS cycle, l_partkey AS part, l_quantity AS qty, l_extendedprice AS price, CASE WHEN l_orderkey % 2 = 1 THEN CAST(trunc(l_quantity) AS BIGINT) ELSE 0 END AS c FROM lineitem)
SELECT run, cycle, part, CAST(bit_count(xor(part, coalesce(lag(part) OVER w, 0))) + bit_count(xor(c, coalesce(lag(c) OVER w, 0))) AS INTEGER) AS toggles FROM z WINDOW w AS (PARTITION BY run ORDER BY cycle, part, qty, price)""",
    "hamming_toggles": f"WITH {LOG_SQL} SELECT run, cycle, part, toggles FROM tg",
    "toggle_summary": f"""WITH {LOG_SQL}, m AS (SELECT avg(CASE WHEN run % 2 = 0 THEN toggles END) AS g, avg(CASE WHEN run % 2 = 1 THEN toggles END) AS t FROM tg)
SELECT round(g, 6) + 0e0 AS mean_golden, round(t, 6) + 0e0 AS mean_modified, round(100e0 * (t - g) / g, 6) + 0e0 AS delta_pct FROM m""",
    "low_toggle_topk": f"WITH {LOG_SQL} SELECT part, CAST(sum(toggles) AS BIGINT) AS total_toggles FROM tg GROUP BY part ORDER BY total_toggles, part LIMIT 10",
    "shunt_voltage": f"""WITH {LOG_SQL}, a AS (SELECT *, CASE WHEN kind = 'O' OR CAST(qty AS INTEGER) % 10 <> 0 THEN 1 ELSE 0 END AS active FROM tg)
SELECT run, cycle, part, CAST(active AS INTEGER) AS active,
  round(8.5e0 + 0.150e0 * toggles + CASE WHEN run % 2 = 1 AND active = 1 THEN 0.350e0 WHEN run % 2 = 1 THEN 0.035e0 ELSE 0e0 END, 6) + 0e0 AS main_mv,
  round(8.5e0 + 0.150e0 * toggles + CASE WHEN run % 2 = 1 THEN 0.035e0 ELSE 0e0 END, 6) + 0e0 AS base_mv FROM a""",
    "trace_differential": """WITH g AS (SELECT l_orderkey, max(l_quantity) AS golden FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), t AS (SELECT l_orderkey, max(l_quantity) AS modified FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT g.l_orderkey AS l_orderkey, golden, modified, modified - golden AS delta FROM g JOIN t ON g.l_orderkey = t.l_orderkey""",
    "parity_mismatch": """WITH x AS (SELECT l_orderkey, l_linenumber % 2 AS odd, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS f FROM lineitem),
g AS (SELECT l_orderkey, max(f) AS golden FROM x WHERE odd = 1 GROUP BY 1), t AS (SELECT l_orderkey, max(f) AS modified FROM x WHERE odd = 0 GROUP BY 1)
SELECT g.l_orderkey AS l_orderkey, golden, modified FROM g JOIN t ON g.l_orderkey = t.l_orderkey WHERE golden IS DISTINCT FROM modified""",
    "average_repeats": "SELECT user_id, event_type, CAST(extract(hour FROM ts) AS INTEGER) AS hour, round(avg(value), 6) + 0e0 AS mean_value, count(value) AS repeats FROM events GROUP BY 1, 2, 3",
    "average_window": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, round(avg(value), 6) + 0e0 AS mean_value, count(value) AS n FROM events GROUP BY 1, 2",
    "cluster_semi": "SELECT c_custkey AS chip, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE substr(o_orderpriority, 1, 1) = '1')",
    "cohort_union": "SELECT c_custkey AS chip, c_mktsegment, 0 AS label FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer WHERE c_custkey % 2 = 1",
    "assignment_map": "SELECT CAST(c_custkey AS VARCHAR) AS chip_id, c_mktsegment AS assigned_cluster, c_name AS ground_truth, round(c_acctbal / 10000, 6) + 0e0 AS membership_golden FROM customer",
    "extra_signals": "SELECT p_brand AS signal, p_size AS width, count(*) AS n FROM part WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM part g WHERE g.p_partkey % 2 = 0 AND g.p_brand = part.p_brand AND g.p_size = part.p_size) GROUP BY 1, 2",
    "register_audit": "SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(4 AS BIGINT) AS signals, CAST(2 * (p_size + 1) + 17 AS BIGINT) AS bits, greatest('mem_q', regexp_replace(lower(p_brand), '[^a-z0-9]', '_', 'g') || '_q', 'flag_' || CAST(p_partkey AS VARCHAR)) AS last_signal FROM part",
    "pipe_table_parse": "SELECT p_partkey AS report_id, 'Slice LUTs*' AS item, CAST(p_size * 7 AS INTEGER) AS used FROM part UNION ALL SELECT p_partkey, 'Slice Registers', CAST(p_size * 11 AS INTEGER) FROM part",
    "report_overhead": """WITH g AS (SELECT p_brand AS device, p_type AS item, CAST(sum(p_size) AS BIGINT) AS golden FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), t AS (SELECT p_brand AS device, p_type AS item, CAST(sum(p_size) AS BIGINT) AS modified FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2)
SELECT g.device AS device, g.item AS item, golden, modified, modified - golden AS delta, round(100e0 * (modified - golden) / golden, 6) + 0e0 AS delta_pct, 100e0 * (modified - golden) / golden <= 0.15e0 AS within FROM g JOIN t ON g.device = t.device AND g.item = t.item""",
    "overhead_verdict": """WITH u AS (SELECT p_brand AS device, sum(CASE WHEN p_partkey % 2 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) END) AS gl, sum(CASE WHEN p_partkey % 2 = 1 THEN CAST(round(p_retailprice * 100) AS BIGINT) END) AS tl,
  sum(CASE WHEN p_partkey % 2 = 0 THEN p_size END) AS gp, sum(CASE WHEN p_partkey % 2 = 1 THEN p_size END) AS tp FROM part GROUP BY 1),
p AS (SELECT device, 100e0 * (tl - gl) / gl AS l, 100e0 * (tp - gp) / gp AS w FROM u WHERE gl IS NOT NULL AND tl IS NOT NULL)
SELECT device, round(l, 6) + 0e0 AS lut_pct, round(w, 6) + 0e0 AS power_pct, l <= 10e0 AND w <= 5e0 AS unnoticed FROM p""",
    "nested_report": """WITH m AS (SELECT n_regionkey, n_nationkey, count(*) AS chips, round(avg(c_acctbal), 6) + 0e0 AS mean FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos, count(*) OVER (PARTITION BY n_regionkey) AS n FROM m)
SELECT n_regionkey, n, CAST(pos - 1 AS INTEGER) AS pos, CAST(n_nationkey AS INTEGER) AS n_nationkey, chips, mean FROM f""",
}
