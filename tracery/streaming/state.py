"""Keyed state over streams of requests: trust windows and cached answers in the order of events, each with a batch twin."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Whether a request (value, time) may use the mark (value, time) that the last one who couldn't has left.
Uses = Callable[[str | None, float, tuple | None], bool]


def trusts(ttl: float) -> Uses:
    """The same known value, less than ttl seconds ago."""
    return lambda value, now, mark: mark is not None and value is not None and mark[0] == value and 0 <= now - mark[1] < ttl


def hits(ttl: float) -> Uses:
    """The same known value, ttl seconds ago at most."""
    return lambda value, now, mark: mark is not None and value is not None and mark[0] == value and 0 <= now - mark[1] <= ttl


class _InOrder(StatefulProcessor):
    """Requests of a key wait until the watermark has passed them, are then decided in their order, and a mark that is too old to be used goes."""

    def __init__(self, uses: Uses, ttl_seconds: float):
        self.uses, self.ttl = uses, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros bigint, request_id bigint, value string")
        self.mark = handle.getValueState("mark", "value string, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_ = pd.concat(list(rows))
        micros = (all_["at"].astype("datetime64[us]").astype("int64")).tolist()
        self.waiting.appendList([(m, None if pd.isna(r) else int(r), v if isinstance(v, str) else None) for m, r, v in zip(micros, all_["request_id"], all_["value"], strict=True)])
        self.handle.registerTimer(-(-min(micros) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= now * 1000]
        rest = rows[len(due) :]
        mark = tuple(self.mark.get()) if self.mark.exists() else None
        out = []
        for micros, _, value in due:
            used = self.uses(value, micros / 1e6, mark)
            out.append(used)
            if not used:
                mark = (value, micros / 1e6)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        if mark is not None:
            gone = math.ceil((mark[1] + self.ttl) * 1000) + 1
            if gone <= now and not rest:
                self.mark.clear()
            else:
                self.mark.update(mark)
                self.handle.registerTimer(max(gone, now + 1))
        if due:
            yield pd.DataFrame({"key": [key[0]] * len(due), "at": pd.to_datetime([r[0] for r in due], unit="us"), "request_id": [r[1] for r in due], "value": [r[2] for r in due], "used": out})

    def close(self) -> None:
        pass


OUT = "key string, at timestamp, request_id long, value string, used boolean"


def decided_stream(requests: DataFrame, uses: Uses, ttl_seconds: float, late: str) -> DataFrame:
    """(key, at, request_id, value, used) of a stream of requests (key, at, request_id, value), in the order of at and request_id, whatever order they come in.

    Requests are held until the watermark, ``late`` behind the latest one, has passed them; those
    that come later still are dropped, which the query's progress counts as rows dropped by
    watermark. State is what waits and one mark a key, which goes once it is older than the
    time. Requests without a time are left out.
    """
    rows = requests.select("key", "at", "request_id", "value").where("at is not null").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_InOrder(uses, ttl_seconds), OUT, "Append", "EventTime")


def decided(requests: DataFrame, uses: Uses) -> DataFrame:
    """The same over a table: sorted by key and order, each key's requests pass one by one, and a task holds one mark, however hot a key is."""

    def run(batches):
        at_key, mark = (), None
        for batch in batches:
            used = []
            micros = batch.column(1).cast(pa.int64()).to_pylist()
            for key, m, value in zip(batch.column(0).to_pylist(), micros, batch.column(3).to_pylist(), strict=True):
                if at_key != (key,):
                    at_key, mark = (key,), None
                used.append(uses(value, m / 1e6, mark))
                if not used[-1]:
                    mark = (value, m / 1e6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(used, pa.bool_())], ["key", "at", "request_id", "value", "used"])

    rows = requests.select(F.col("key").cast("string"), F.col("at").cast("timestamp"), F.col("request_id").cast("long"), F.col("value").cast("string")).where("at is not null")
    return rows.repartition("key").sortWithinPartitions("key", "at", "request_id", F.coalesce("value", F.lit(""))).mapInArrow(run, OUT)


def _refreshed(rows: DataFrame) -> DataFrame:
    return rows.select("key", "at", "request_id", F.col("value").alias("fingerprint"), (~F.col("used")).alias("refreshed"))


def trust_window_stream(requests: DataFrame, ttl_seconds: int, late: str = "1 day") -> DataFrame:
    """Requests (key, at, request_id, fingerprint) with refreshed: false where the last refresh of the key was of the same known state and younger than the time."""
    return _refreshed(decided_stream(requests.withColumnRenamed("fingerprint", "value"), trusts(ttl_seconds), ttl_seconds, late))


def trust_window(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """The same over a table."""
    return _refreshed(decided(requests.withColumnRenamed("fingerprint", "value"), trusts(ttl_seconds)))


def _layered(rows: DataFrame) -> DataFrame:
    return rows.select("key", "at", "request_id", F.col("value").alias("snapshot"), F.when(F.col("used"), "hit").otherwise("miss").alias("layer"))


def cache_stream(requests: DataFrame, ttl_seconds: int, late: str = "1 day") -> DataFrame:
    """Requests (key, at, request_id, snapshot) with layer: a hit if the key's answer was computed for the same snapshot within the time, else a miss, whose answer is kept."""
    return _layered(decided_stream(requests.withColumnRenamed("snapshot", "value"), hits(ttl_seconds), ttl_seconds, late))


def cache_table(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """The same over a table."""
    return _layered(decided(requests.withColumnRenamed("snapshot", "value"), hits(ttl_seconds)))


def answered(queries: DataFrame, answer, path: str, checkpoint: str) -> None:
    """Continuous retrieval: answer(queries) of each micro-batch of a stream of queries is added to the table at path; a batch that is run again replaces its rows."""

    def write(batch: DataFrame, n: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    queries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
