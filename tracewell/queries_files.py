"""Queries that write tables as files of the measuring bench, or stream them, and read back what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.reports import parse_pipe_tables
from tracewell.queries_frequency import r6, table
from tracewell.sources import read_chip_vectors, read_cycle_logs, read_reports, write_traces
from tracewell.sources.shared import new_path
from tracewell.streaming import toggles_stream

#: Chips to a document of chip vectors.
CHIPS = 100


def q_cycle_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as logs of two cores with unlike headers, and a stub; odd orders are the modified core."""
    path = new_path(spark, "logs")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 2 == 1).alias("odd"), F.col("l_linenumber").alias("cycle"), F.col("l_orderkey").alias("timestamp_ns"),
        (F.col("l_partkey") % 129).cast("int").alias("hamming_toggles"), "l_quantity", (F.col("l_linestatus") == "O").alias("open"),
    )
    common = ["cycle", "timestamp_ns", "hamming_toggles"]
    golden = rows.where("not odd").select(*common, (F.col("l_quantity") / 1000).alias("vccint_shunt_v"), F.col("open").cast("int").alias("cipher_match"))
    modified = rows.where("odd").select(*common, F.col("l_quantity").alias("vccint_shunt_mv"), F.when(F.col("open"), "1").otherwise("x").alias("trojan_active"))
    stub = rows.groupBy().agg(F.count("*").alias("cycle"), F.lit(0).alias("timestamp_ns"))
    for core, log in (("golden", golden), ("modified", modified), ("stub", stub)):
        log.write.option("header", True).csv(f"{path}/core={core}")
    found = read_cycle_logs(spark, path, min_bytes=70, core=r"core=([a-z]+)/")
    return found.select("core", *common, r6("vccint_shunt_v").alias("volts"), "cipher_match", "trojan_active")


def q_chip_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as documents of a hundred chips each; chips with odd numbers are for validation."""
    path = new_path(spark, "chips")
    ev = F.transform("embedding", lambda x: x.cast("double"))
    chips = table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.col("vec_id").cast("string").alias("chip_id"), F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("label"), F.when(F.col("vec_id") % 2 == 1, F.col("label")).alias("ground_truth"), F.lit("embedding").alias("category"), ev.alias("ev")).alias("chip"))
    part = lambda odd: F.collect_list(F.when(F.col("vec_id") % 2 == odd, F.col("chip")))
    chips.groupBy(F.floor(F.col("vec_id") / CHIPS).alias("block")).agg(part(0).alias("training_chips"), part(1).alias("validation_chips")).drop("block").write.json(path)
    found = read_chip_vectors(spark, path, lines=True)
    energy = F.aggregate("ev", F.lit(0.0), lambda s, x: s + x * x)
    return found.select("split", "chip_id", "label", "category", F.size("ev").alias("places"), r6(energy).alias("energy"))


def q_text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each brand in a file of its own, with a line for each size that counts its parts."""
    path = new_path(spark, "reports")
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("| Size "), F.col("p_size").cast("string"), F.lit(" | "), F.col("n").cast("string"), F.lit(" | 0 |"))
    text = F.concat(F.lit("| Site Type | Used | Fixed |\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    counts.groupBy(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("report")).agg(text.alias("value")).write.partitionBy("report").text(path)
    return parse_pipe_tables(read_reports(spark, path, name=r"report=([^/]+)/"), ["Size "])


def q_trace_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as wide traces in folders by split; only the one for validation is read."""
    path = new_path(spark, "traces")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chip"), "label", F.when(F.col("vec_id") % 3 == 0, "validation").otherwise("train").alias("split"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    write_traces(rows, path)
    found = spark.read.parquet(path).where("split = 'validation'")
    return found.select("chip", "label", F.size("samples").alias("n"), r6(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def q_toggle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as a continuous log, streamed to its end; prices are states."""
    orders = table(spark, sf_dir, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/[o]rders.parquet")  # a pattern: the table may be a file or a folder
    log = stream.select(F.col("o_custkey").alias("core"), F.col("o_orderkey").alias("cycle"), F.floor("o_totalprice").alias("state"))
    path = new_path(spark, "toggles")
    toggles_stream(log, None).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("core", "cycle", "state", "toggles", "late")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
ORACLE_SQL = {
    "cycle_logs": """SELECT CASE WHEN l_orderkey % 2 = 1 THEN 'modified' ELSE 'golden' END AS core, l_linenumber AS cycle, l_orderkey AS timestamp_ns, CAST(l_partkey % 129 AS INTEGER) AS hamming_toggles, round(l_quantity / 1000e0, 6) + 0e0 AS volts,
  CASE WHEN l_orderkey % 2 = 1 THEN NULL WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS cipher_match, CASE WHEN l_orderkey % 2 = 1 AND l_linestatus = 'O' THEN 1 END AS trojan_active FROM lineitem""",
    "chip_vectors": """SELECT CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'validation' END AS split, CAST(vec_id AS VARCHAR) AS chip_id, label, 'embedding' AS category, CAST(len(embedding) AS INTEGER) AS places,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) + 0e0 AS energy FROM embeddings""",
    "text_reports": "SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS report_id, 'Size ' || CAST(p_size AS VARCHAR) AS item, CAST(count(*) AS INTEGER) AS used FROM part GROUP BY 1, 2",
    "trace_store": "SELECT vec_id AS chip, label, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0e0 AS total FROM embeddings WHERE vec_id % 3 = 0",
    "toggle_stream": """SELECT CAST(o_custkey AS VARCHAR) AS core, o_orderkey AS cycle, s AS state, CAST(bit_count(xor(s, coalesce(lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0))) AS INTEGER) AS toggles, false AS late
FROM (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders) z""",
}
