"""Tool reports and design sources as tables: pipe tables, overhead verdicts, register audits, nested reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits in percent under which a change passes unnoticed.
LUT_LIMIT, POWER_LIMIT = 0.15, 0.10
#: Parts of the language's grammar: comments and texts, a range, a name, and a declaration up to its semicolon.
COMMENT = r"(?s)//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\""
RANGE = r"\[[^\]]*\]"
NAME = r"^([A-Za-z_][\w$]*|\\\S+)"
DECLARATION = rf"(?<![\w$\\])reg\b((?:{RANGE}|\([^()]*\)|(?!\b(?:input|output|inout|reg|wire)\b)[^;()\[\]])*)"


def parse_pipe_tables(reports: DataFrame, items: Sequence[str], report: str = "report_id", text: str = "value") -> DataFrame:
    """``report, item, used`` from the lines of a report's tables that contain one of ``items``; fields stand between bars.

    Empty fields don't count; a line whose second field is no whole number gives a null.
    """
    lines = reports.select(F.col(report).alias("report_id"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines = lines.where(F.greatest(*(F.contains("line", F.lit(i)).cast("int") for i in items), F.lit(0)) == 1)
    fields = F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select("report_id", fields.alias("f")).where(F.size("f") >= 2).select("report_id", F.get("f", F.lit(0)).alias("item"), F.expr("try_cast(f[1] as int)").alias("used"))


def report_overhead(golden: DataFrame, modified: DataFrame, on: Sequence[str] = ("device", "item"), used: str = "used", limit: float | Column = LUT_LIMIT, available: str | None = None) -> DataFrame:
    """``on, golden, modified, delta, delta_pct, within``: what the modified design uses more, and whether it stays unnoticed.

    With ``available``, a column of the golden rows, also ``capacity_pct``: the difference as a share of the device.
    """
    room = [F.col(available).alias("available")] if available else []
    both = golden.select(*on, F.col(used).alias("golden"), *room).join(modified.select(*on, F.col(used).alias("modified")), list(on))
    if available:
        both = both.withColumn("capacity_pct", F.try_divide(100.0 * (F.col("modified") - F.col("golden")), F.col("available"))).drop("available")
    both = both.withColumn("delta", F.col("modified") - F.col("golden")).withColumn("delta_pct", F.try_divide(100.0 * F.col("delta"), F.col("golden")))
    return both.withColumn("within", F.coalesce(F.col("delta_pct") <= limit, F.col("delta") <= 0))


def overhead_verdict(overheads: DataFrame, lut: str, power: str, by: Sequence[str] = ("device",), lut_limit: float = LUT_LIMIT, power_limit: float = POWER_LIMIT) -> DataFrame:
    """``by, lut_pct, power_pct, unnoticed``: both changes of a device in percent, and whether both stay within their limits.

    ``overheads`` is what ``report_overhead`` returns, with ``lut`` and ``power`` among its items.  A device of which
    one figure is missing has no verdict; a change from 0 has no percentage and counts by its sign alone.
    """
    of = lambda item, what: F.max(F.when(F.col("item") == item, F.col(what)))
    found = overheads.groupBy(*by).agg(
        of(lut, "delta_pct").alias("lut_pct"), of(power, "delta_pct").alias("power_pct"), of(lut, "delta").alias("lut_delta"), of(power, "delta").alias("power_delta")
    )
    fits = lambda name, limit: F.coalesce(F.col(f"{name}_pct") <= limit, F.col(f"{name}_delta") <= 0)
    return found.withColumn("unnoticed", fits("lut", lut_limit) & fits("power", power_limit)).drop("lut_delta", "power_delta")


def register_audit(sources: DataFrame, file: str = "file", text: str = "value") -> DataFrame:
    """``file, signal, width`` of every register declared in a source.

    Comments and texts in quotes are taken out first.  A declaration may be ``signed`` and have a range; each of its
    names may have ranges of its own, as a memory of so many words has, and a value to begin with.  A register
    without a range has width 1, a memory the bits of all its words; a range that isn't two numbers gives a null.
    """
    bare = F.regexp_replace(F.col(text), F.lit(COMMENT), F.lit(" "))
    found = sources.select(F.col(file).alias("file"), F.explode(F.regexp_extract_all(bare, F.lit(DECLARATION), F.lit(1))).alias("d"))
    found = found.withColumn("d", F.regexp_replace("d", r"^\s*signed\b", ""))
    head = F.regexp_extract("d", rf"^\s*((?:{RANGE}\s*)*)", 1)
    names = found.select("file", head.alias("head"), F.regexp_replace("d", rf"^\s*(?:{RANGE}\s*)*", "").alias("names"))
    # Commas part names, but not inside the brackets of a first value.
    names = names.select("file", "head", F.explode(F.split(F.regexp_replace("names", r"\{[^{}]*\}|\([^()]*\)", "0"), ",")).alias("one"))
    one = F.trim(F.regexp_replace(F.regexp_extract("one", r"(?s)^([^=]*)", 1), r"\s+", " "))
    names = names.select("file", "head", one.alias("one")).withColumn("signal", F.regexp_extract("one", NAME, 1)).where("signal <> ''")
    ranges = F.regexp_extract_all(F.concat_ws(" ", "head", "one"), F.lit(RANGE), F.lit(0))
    bound = lambda r, k: F.get(F.split(F.translate(r, "[] \t\r\n", ""), ":"), k).try_cast("int")
    sizes = F.transform(ranges, lambda r: F.abs(bound(r, 0) - bound(r, 1)) + 1)
    return names.select("file", "signal", F.aggregate(sizes, F.lit(1), lambda bits, size: bits * size).alias("width"))


def extra_signals(modified: DataFrame, golden: DataFrame, on: Sequence[str] = ("signal", "width")) -> DataFrame:
    """The signals of the modified design that the golden one doesn't have at that width."""
    return modified.join(golden.select(*on).distinct(), list(on), "left_anti")


def nested_report(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``by, n, report``: the rows of each group as one JSON array, in order; a group is a report, not a data set."""
    others = [c for c in rows.columns if c not in by]
    keys = [*order, *[c for c in others if c not in order]]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(F.struct(*keys)))).alias("report"))


def sweep_report(rows: DataFrame, experiment: str, condition: str, method: str, metrics: Sequence[str]) -> DataFrame:
    """``experiment, report``: a JSON object for each experiment, as sweeps are published.

    It has the conditions in order as ``conditions``, and for each method an object of arrays, one for each metric with a
    value for each condition; a condition that a method lacks has null.  Rows without a condition are left out, a null method
    is an empty name, and of rows of one condition and method the largest counts.  A sweep is a report, not a data set.
    """
    rows = rows.where(F.col(condition).isNotNull()).withColumn(method, F.coalesce(F.col(method).cast("string"), F.lit("")))
    rows = rows.groupBy(experiment, condition, method).agg(F.max(F.struct(*metrics)).alias("m"))
    by_condition = rows.groupBy(experiment, method).agg(F.map_from_entries(F.collect_list(F.struct(F.col(condition).cast("string").alias("c"), "m"))).alias("found"))
    known = rows.groupBy(experiment).agg(F.array_sort(F.collect_set(condition)).alias("conditions"))
    both = by_condition.join(known.withColumnRenamed(experiment, "__of"), F.col(experiment).eqNullSafe(F.col("__of")))
    at = lambda c: F.try_element_at("found", c.cast("string"))
    array = lambda m: F.transform("conditions", lambda c: at(c)[m])
    arrays = F.struct(*(array(m).alias(m) for m in metrics))
    methods = both.select(experiment, "conditions", method, arrays.alias("arrays"))
    whole = methods.groupBy(experiment).agg(F.first("conditions").alias("conditions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(method, "arrays")))).alias("methods"))
    return whole.select(F.col(experiment).alias("experiment"), F.to_json(F.struct("conditions", "methods"), {"ignoreNullFields": "false"}).alias("report"))
