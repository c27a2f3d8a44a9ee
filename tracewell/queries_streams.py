"""Queries over streams, stored models and bucketed logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import queries_logs, queries_models
from tracewell.operators.detect import score
from tracewell.operators.spectral import features
from tracewell.operators.traces import differential, hamming_toggles
from tracewell.plans import fixture
from tracewell.queries_frequency import r6, table
from tracewell.queries_models import fixed_detector, rounded_scores
from tracewell.sources import load_version, publish_detectors
from tracewell.sources.buckets import write_buckets
from tracewell.sources.shared import new_path, written
from tracewell.streaming import average_stream, keep_state_in_rocksdb, ordered_toggles, read_verdicts, verdict_stream

#: Cores of the log that is streamed out of order, and buckets of the logs that are stored.
CORES, BUCKETS = 64, 8


def q_stored_model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a detector that was published, and loaded by its version."""
    vectors = written(fixture.chip_vectors(spark, sf_dir), "chips")
    models = new_path(spark, "models")
    version = publish_detectors(spark, fixed_detector(vectors), models)
    return rounded_scores(score(vectors.drop("ev_bin"), load_version(spark, models, version)))


def q_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts from a stream over written traces, half of the files to a batch; the traces are made once."""
    path = new_path(spark, "verdicts")
    traces = written(fixture.traces(spark, sf_dir), "traces")
    vectors = features(traces, fixture.LO, fixture.HI, fixture.BINS).withColumnRenamed("ev_band", "ev")
    publish_detectors(spark, fixed_detector(vectors), f"{path}/models")
    files = traces.inputFiles()
    stream = spark.readStream.schema(traces.schema).option("maxFilesPerTrigger", -(-len(files) // 2)).parquet(files[0].rpartition("/")[0])
    query = verdict_stream(stream, f"{path}/models", f"{path}/out", f"{path}/checkpoint", fixture.LO, fixture.HI, fixture.BINS, available_now=True)
    query.awaitTermination()
    return rounded_scores(read_verdicts(spark, f"{path}/out"))


def q_ordered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the continuous logs of 64 cores, which arrive in three files without order; prices are states."""
    place = F.row_number().over(Window.partitionBy("core").orderBy("o_orderkey", "o_custkey", "o_totalprice")).cast("long")
    rows = table(spark, sf_dir, "orders").withColumn("core", F.col("o_custkey") % CORES).withColumn("cycle", place)
    path = new_path(spark, "ordered")
    log = rows.select("core", "cycle", F.floor("o_totalprice").alias("state"))
    log.repartition(3, F.xxhash64("core", "cycle")).sortWithinPartitions(F.xxhash64("cycle", "state")).write.parquet(f"{path}/log")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keep_state_in_rocksdb(spark)
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
        writer = ordered_toggles(stream, delay_ms=None).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{path}/rows").select("core", "cycle", "state", "toggles", "late")


def q_average_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of closed windows in append mode, from four files in order of time: two halves of the events, one event of a far
    day that closes all windows, and one that comes late and is left out."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value").where("ts is not null")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    both = events.crossJoin(F.broadcast(events.agg(F.timestamp_micros(F.avg(F.unix_micros("ts")).cast("long")).alias("half"))))  # one row
    odd = lambda at, value: events.limit(1).select(F.lit(at).cast("timestamp").alias("ts"), "event_type", F.lit(value).alias("value"))
    parts = [both.where("ts < half").drop("half"), both.where("ts >= half").drop("half"), odd("2100-01-01 00:00:00", 1.0), odd("2024-01-02 00:00:00", 1e9)]
    path = new_path(spark, "events")
    for k, part in enumerate(parts):  # files are taken in the order in which they were written
        part.coalesce(1).write.parquet(f"{path}/in/part={k}")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    found = average_stream(stream, ["event_type"], "value", "6 hours")
    found.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", r6("mean_value").alias("mean_value"), "n")


def q_bucketed_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toggles of a log that is stored in buckets by run: the window over a run shuffles nothing."""
    log = write_buckets(queries_logs.plain_log(spark, sf_dir), ["run"], queries_logs.ORDER, BUCKETS)
    return hamming_toggles(log, ["run"], queries_logs.ORDER, ["part"], queries_logs.counter()).select("run", "cycle", "part", "toggles")


def q_bucketed_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs in equal buckets, compared in lockstep without an exchange."""
    golden, modified = (write_buckets(log, ["l_orderkey"], [], BUCKETS) for log in queries_logs.two_logs(spark, sf_dir, F.col("l_quantity")))
    return differential(golden, modified, ["l_orderkey"], "out")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
ORACLE_SQL = {
    "stored_model_score": queries_models.ORACLE_SQL["fusion_score"],
    "stream_score": queries_models.ORACLE_SQL["fusion_score"],
    "ordered_stream": f"""WITH l AS (SELECT o_custkey % {CORES} AS core, row_number() OVER (PARTITION BY o_custkey % {CORES} ORDER BY o_orderkey, o_custkey, o_totalprice) AS cycle, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)
SELECT CAST(core AS VARCHAR) AS core, cycle, s AS state, CAST(bit_count(xor(s, coalesce(lag(s) OVER (PARTITION BY core ORDER BY cycle), 0))) AS INTEGER) AS toggles, false AS late FROM l""",
    "average_stream": queries_logs.ORACLE_SQL["average_window"],
    "bucketed_toggles": queries_logs.ORACLE_SQL["hamming_toggles"],
    "bucketed_differential": queries_logs.ORACLE_SQL["trace_differential"],
}
