"""Keyed streams whose batches come out of order, against their batch twins."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tracery.streaming import state, telemetry

SCHEMA = "key string, at timestamp, request_id long, value string"


def written(spark, batches):
    """A folder with a file for each batch, read one by one."""
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, s double, request_id long, value string").select("key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("at"), "request_id", "value").coalesce(1).write.parquet(f"file://{root}/{i:03d}")
    return root


def streamed(spark, root):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"file://{root}")


def test_batches_out_of_order_equal_the_table(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot"]), float(rng.randint(0, 3000)) / 2, i, rng.choice(["x", "x", "y", None])) for i in range(240)]
    rows += [("a", 5.0, 1000, "x"), ("a", 5.0, 1001, "x"), ("t", 10.0, 1002, "x"), ("t", 110.0, 1003, "x"), ("t", 209.9, 1004, "x")]
    rng.shuffle(rows)
    root = written(spark, [*(rows[i::4] for i in range(4)), [(None, 5e9, None, None)]])
    table = spark.read.option("recursiveFileLookup", True).parquet(f"file://{root}").where("key is not null")
    for uses in (state.trusts(100), state.hits(100)):
        stream = state.decided_stream(streamed(spark, root), uses, 100, "10 hours")
        got = telemetry.run_available(stream, "append", state_store=True)
        want = sorted(map(tuple, state.decided(table, uses).collect()))
        assert sorted(map(tuple, got.collect())) == want and len(want) == len(rows)
    used = {r.request_id: r.used for r in state.decided(table, state.trusts(100)).collect()}
    # the last batch, far ahead, lets all others through; 110 is 100 after the mark at 10, which is too old, and becomes the mark of 209.9
    assert (used[1002], used[1003], used[1004]) == (False, False, True)


def test_late_requests_go_and_marks_expire(spark):
    root = written(spark, [[("k", 100.0, 1, "x")], [("k", 50.0, 2, "x")], [("k", 50_000.0, 3, "x")], [("m", 50_001.0, 6, "y")], [("k", 60.0, 4, "x")], [("m", 100_000.0, 5, "y")]])
    out = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = state.decided_stream(streamed(spark, root), state.trusts(100), 100, "1000 seconds").writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").option("path", f"{out}/rows").start()
        q.awaitTermination()
        progress = q.recentProgress
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r.request_id: r.used for r in spark.read.parquet(f"{out}/rows").collect()}
    # 50 came after 100, within the lateness: it is first and 100 may use its mark
    assert got == {2: False, 1: True, 3: False, 6: False}
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4


@pytest.mark.parametrize("n", [20_000])
def test_a_hot_key_is_one_pass(spark, n):
    rows = spark.range(n).select(F.lit("hot").alias("key"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("request_id"), F.lit("x").alias("value"))
    got = state.decided(rows, state.trusts(10)).where("not used")
    assert got.count() == n // 10
    assert state.decided(rows.limit(0), state.trusts(10)).count() == 0


def test_a_batch_that_runs_again_replaces_its_rows(spark):
    root = written(spark, [[("k", 1.0, 1, "x")], [("l", 2.0, 2, None)]])
    got = telemetry.run_available(streamed(spark, root).select("key", "request_id"), "append")
    assert sorted(map(tuple, got.collect())) == [("k", 1), ("l", 2)] and got.columns == ["key", "request_id"]
