"""Telemetry as streams: rollups by window, first findings, requests. Each has a batch twin that tests it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import quantiles
from ..sources.scratch import folder

_STORE = "spark.sql.streaming.stateStore.providerClass"


def rollup(events: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total, p50, p95) by tumbling windows, or sliding ones; works on tables, and on streams, where quantiles are approximate.

    In append mode a window's row comes once the watermark has passed its end; events that are
    later than ``late`` are dropped, and so is the state of windows that are done. In complete
    mode nothing is dropped and all windows stay in the state.
    """
    total = F.round(F.sum("value"), 2).alias("total")
    if not events.isStreaming:
        rows = events.select(F.window("ts", width, slide).start.alias("window_start"), "event_type", "value")
        got = quantiles(rows, ["window_start", "event_type"], "value", {"p50": 0.5, "p95": 0.95}, F.count("*").alias("rows"), total)
        return got.select("window_start", "event_type", F.col("rows").alias("n"), "total", "p50", "p95")
    quantile = lambda q: F.percentile_approx("value", q, 10_000)
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), total, quantile(0.5).alias("p50"), quantile(0.95).alias("p95"))
    return by.select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "p50", "p95")


def run_available(stream: DataFrame, mode: str = "complete", state_store: bool = False) -> DataFrame:
    """Runs a stream over what is there now and reads its table: the last state (complete) or all that was appended. Keyed processors need the store named, which is set for this run alone."""
    spark: SparkSession = stream.sparkSession
    if state_store:
        before = spark.conf.get(_STORE, None)
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            return run_available(stream, mode)
        finally:
            spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    path = folder(spark)

    def write(batch: DataFrame, n: int) -> None:
        # a batch that is run again replaces its own rows
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    # the number of a batch is no column of the result
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def ended(stream: DataFrame, at: str, end: str = "2200-01-01 00:00:00") -> DataFrame:
    """A stream with one row more, of nulls but for its time, far ahead: where a stream has an end, it brings the watermark past all the others."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/end"
    spark.range(1).select(*((F.lit(end) if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema)).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # as a pattern, since a stream takes a single file for no other path
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def first_findings(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key to arrive within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, begin, n, total) by gaps in a user's events, in streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select("user_id", F.col("w.start").alias("begin"), "n", F.round("total", 2).alias("total"))
