"""Tables and named values in the text reports of design tools: power, timing and utilization.

A report's lines are numbered; headings, the rules of tables and the headers above them are carried forward by windows
over the report, so that each line knows its section, its table and its columns.  Two kinds of tables are known: framed
ones with bars, whose rules are made of plus signs and dashes, and plain ones below a rule of dashes with gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = r"^\+(-+\+)+$"
RULE = r"^\s*-+(\s+-+)+$"
UNDERLINE = r"^-+$"
BOXED = r"^\| -+$"
NUMBER = r"^<?\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
#: A unit stands right behind its number.
UNIT = r"(%|[A-Za-zµ]+)?(?=$|[\s=(])"
#: A name, a colon and what is behind it; lines of tables have bars in it.
PAIR = r"^(?:\| )?\s*([A-Za-z][^:|]*?)\s*:\s+(\S.*)$"


def number(text: Column) -> Column:
    """The number that a field begins with; null for ``NA``, dashes and words.  ``<0.001`` gives its limit."""
    return F.regexp_extract(text, NUMBER + r"\s*(?:%|[A-Za-z]*)$", 1).try_cast("double")


def report_lines(reports: DataFrame, report: str = "report_id", text: str = "value") -> DataFrame:
    """``report_id, n, line, section``: numbered lines with the heading that they stand under.

    A heading is underlined by dashes of its own, or stands in a box of bars and dashes.
    """
    lines = reports.select(F.col(report).alias("report_id"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    lines = lines.withColumn("line", F.rtrim(F.regexp_replace("line", "[\r\t]", " ")))
    order = Window.partitionBy("report_id").orderBy("n")
    below = F.lead("line", 1, "").over(order)
    boxed = F.col("line").startswith("| ") & below.rlike(BOXED)
    plain = below.rlike(UNDERLINE) & F.col("line").rlike(r"^[A-Za-z0-9]") & ~F.contains("line", F.lit(":")) & ~F.col("line").startswith("|")
    title = F.when(boxed, F.trim(F.expr("substring(line, 2)"))).when(plain, F.trim("line"))
    return lines.withColumn("title", title).withColumn("section", F.last("title", ignorenulls=True).over(order))


def _spans(rule: Column) -> Column:
    """``struct(first, last)`` of each column of a rule: places of its dashes, from 1."""
    runs = F.regexp_extract_all(rule, F.lit(r"[^-]*-+"), F.lit(0))
    ends = F.transform(runs, lambda _, k: F.aggregate(F.slice(runs, F.lit(1), k + 1), F.lit(0), lambda s, r: s + F.length(r)))
    return F.zip_with(ends, F.transform(runs, lambda r: F.length(F.regexp_extract(r, "-+$", 0))), lambda end, size: F.struct((end - size + 1).alias("first"), end.alias("last")))


def _fields(line: Column, spans: Column, framed: Column) -> Column:
    """The fields of a line.

    In a frame they lie between the bars; of a bar inside a field the frame's rule knows.  Below a plain rule a field may be
    wider than its dashes on either side: columns part at the last blank of the gap between two runs.
    """
    count = F.size(spans)
    by_span = F.transform(spans, lambda s: line.substr(s["first"], s["last"] - s["first"] + 1))
    # Every column is followed by its bar where the rule says so, or the line isn't laid out by the rule.
    aligned = F.forall(spans, lambda s: line.substr(s["last"] + 1, F.lit(1)) == "|")
    by_bar = F.slice(F.split(line, r"\|"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(line, r"\|")) - 2))

    def cut(k: Column) -> Column:
        """The last place of column ``k``."""
        gap = F.get(spans, k)["last"] + 1
        size = F.get(spans, k + 1)["first"] - gap
        blank = F.locate(" ", F.reverse(line.substr(gap, size)))
        return F.when(k >= count - 1, F.length(line)).when(blank > 0, gap + size - blank).otherwise(gap + size - 1)

    by_gap = F.transform(spans, lambda s, k: line.substr(F.when(k == 0, 1).otherwise(cut(k - 1) + 1), cut(k) - F.when(k == 0, 0).otherwise(cut(k - 1))))
    return F.transform(F.when(framed & aligned, by_span).when(framed, by_bar).otherwise(by_gap), lambda x: F.trim(x))


def report_cells(reports: DataFrame, report: str = "report_id", text: str = "value") -> DataFrame:
    """``report_id, section, n, k, column, item, text, value, below`` of every field of every table.

    ``n`` is the line, ``k`` the field's place from 0, ``column`` the header above it (null in a table without one) and
    ``item`` the first field of its line.  ``value`` is the number, null where there is none, and ``below`` is true where
    only a limit is given, as in ``<0.001``.  Empty fields are rows with an empty text.
    """
    lines = report_lines(reports, report, text)
    order = Window.partitionBy("report_id").orderBy("n")
    line = F.col("line")
    framed = line.startswith("|") | line.startswith("+")
    # A block is what stands together: it ends with an empty line and where framed lines begin or end.
    lines = lines.withColumn("framed", framed).withColumn("above", F.lag("line", 1, "").over(order))
    edge = (line == "") | (F.col("framed") != F.lag("framed", 1, False).over(order))
    lines = lines.withColumn("block", F.sum(edge.cast("int")).over(order))
    is_rule = line.rlike(FRAME) | line.rlike(RULE)
    inside = Window.partitionBy("report_id", "block").orderBy("n")
    whole = Window.partitionBy("report_id", "block")
    lines = lines.withColumn("rules", F.sum(is_rule.cast("int")).over(inside)).withColumn("all_rules", F.sum(is_rule.cast("int")).over(whole)).where("all_rules > 0")
    lines = lines.withColumn("spans", F.first(F.when(is_rule, _spans(line)), ignorenulls=True).over(inside))
    # The header is below the first of three rules of a frame, and above the first rule of a plain table.
    titled = F.col("framed") & (F.col("all_rules") >= 3)
    header = F.when(titled & (F.col("rules") == 1) & ~is_rule, line).when(~F.col("framed") & is_rule & (F.col("rules") == 1), F.col("above"))
    lines = lines.withColumn("header", F.first(header, ignorenulls=True).over(inside))
    data = lines.where(~is_rule & (line != "") & (F.col("rules") > F.when(titled, 1).otherwise(0)))
    data = data.withColumn("fields", _fields(line, F.col("spans"), F.col("framed"))).withColumn("names", _fields(F.col("header"), F.col("spans"), F.col("framed")))
    cells = data.select("report_id", "section", "n", "names", F.get("fields", F.lit(0)).alias("item"), F.posexplode("fields").alias("k", "text"))
    name = F.get("names", F.col("k"))
    return cells.select("report_id", "section", "n", "k", F.when(name != "", name).alias("column"), "item", "text", number(F.col("text")).alias("value"), F.col("text").startswith("<").alias("below"))


def report_pairs(reports: DataFrame, report: str = "report_id", text: str = "value") -> DataFrame:
    """``report_id, section, n, path, item, text, value, unit`` of the lines that name a value behind a colon.

    ``path`` counts the timing paths of a report, each of which begins with its slack.
    """
    lines = report_lines(reports, report, text).where(F.col("line").rlike(PAIR))
    item, found = F.regexp_replace(F.regexp_extract("line", PAIR, 1), r"\s+", " "), F.regexp_extract("line", PAIR, 2)
    lines = lines.select("report_id", "section", "n", item.alias("item"), found.alias("text"))
    starts = F.sum(F.col("item").startswith("Slack").cast("int")).over(Window.partitionBy("report_id").orderBy("n"))
    unit = F.regexp_extract("text", NUMBER + UNIT, 2)
    value = F.regexp_extract("text", NUMBER + UNIT, 1).try_cast("double")
    return lines.select("report_id", "section", "n", starts.alias("path"), "item", "text", value.alias("value"), F.when(value.isNotNull() & (unit != ""), unit).alias("unit"))


def _figure(condition: Column, value: str = "value", least: bool = False) -> Column:
    return (F.min if least else F.max)(F.when(condition, F.col(value)))


def power_figures(reports: DataFrame, report: str = "report_id", text: str = "value") -> DataFrame:
    """``report_id, total_w, dynamic_w, static_w, dynamic_below``: the summary of each power report; a report without one has no row."""
    cells = report_cells(reports, report, text).where("k = 1 and column is null and item in ('Total On-Chip Power (W)', 'Dynamic (W)', 'Device Static (W)')")
    of = lambda item, value="value": _figure(F.col("item") == item, value)
    return cells.groupBy("report_id").agg(of("Total On-Chip Power (W)").alias("total_w"), of("Dynamic (W)").alias("dynamic_w"), of("Device Static (W)").alias("static_w"), of("Dynamic (W)", "below").alias("dynamic_below"))


def timing_figures(reports: DataFrame, report: str = "report_id", text: str = "value") -> DataFrame:
    """``report_id, wns_ns, tns_ns, whs_ns, endpoints, period_ns, fmax_mhz``: worst slacks, the fastest clock, and the rate that the slack leaves.

    A report without a timing summary has no row; without a clock its period and rate are null.
    """
    cells = report_cells(reports, report, text).where("section in ('Design Timing Summary', 'Clock Summary')")
    of = lambda column, section="Design Timing Summary", least=True: _figure((F.col("column") == column) & (F.col("section") == section), least=least)
    found = cells.groupBy("report_id").agg(
        of("WNS(ns)").alias("wns_ns"), of("TNS(ns)").alias("tns_ns"), of("WHS(ns)").alias("whs_ns"), of("TNS Total Endpoints", least=False).cast("long").alias("endpoints"), of("Period(ns)", "Clock Summary").alias("period_ns")
    )
    left = F.col("period_ns") - F.col("wns_ns")
    return found.where("wns_ns is not null").withColumn("fmax_mhz", F.when(left > 0, 1000.0 / left))


def path_delays(reports: DataFrame, report: str = "report_id", text: str = "value") -> DataFrame:
    """``report_id, path, section, slack_ns, met, delay_ns, levels`` of each timing path."""
    pairs = report_pairs(reports, report, text).where("path > 0")
    of = lambda start: _figure(F.col("item").startswith(start))
    first = F.col("item").startswith("Slack")
    met = F.max(F.when(first, F.contains("item", F.lit("MET"))))
    return pairs.groupBy("report_id", "path").agg(F.max(F.when(first, F.col("section"))).alias("section"), of("Slack").alias("slack_ns"), met.alias("met"), of("Data Path Delay").alias("delay_ns"), of("Logic Levels").cast("int").alias("levels"))


def report_figures(utilization: DataFrame, power: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """``report_id, item, used``: what ``report_overhead`` compares, from parsed reports of each design.

    Items are the rows of the utilization tables that have a ``Used`` column, ``Dynamic (W)`` and ``Critical path (ns)``,
    the period less the worst slack.
    """
    used = report_cells(utilization).where("column = 'Used' and value is not null").groupBy("report_id", "item").agg(F.max("value").alias("used"))
    out = used.unionByName(power_figures(power).where("dynamic_w is not null").select("report_id", F.lit("Dynamic (W)").alias("item"), F.col("dynamic_w").alias("used")))
    if timing is not None:
        out = out.unionByName(timing_figures(timing).where("period_ns is not null").select("report_id", F.lit("Critical path (ns)").alias("item"), (F.col("period_ns") - F.col("wns_ns")).alias("used")))
    return out
