"""Streams with state of their own: processors with value, list and map state, timers, restarts; late rows; other sources and sinks."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import drained, events, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The user of rows that only move the watermark.
MARKER = -1


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which processors need, and which keeps large state off the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def in_steps(spark: SparkSession, steps: list[DataFrame], watermark: str = "10 minutes") -> DataFrame:
    """A stream that takes one of the tables a micro-batch, in order; they have a column ``ts``."""
    path = scratch(spark, "steps")
    for k, rows in enumerate(steps):
        rows.coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(steps[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return stream.withWatermark("ts", watermark)


def _with_markers(spark: SparkSession, sf_dir: str, again: bool) -> list[DataFrame]:
    """All events, then two rows a day later, which close what is open; ``again``: then the events once more, too late."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id", "event_type")

    def marker(days: int) -> DataFrame:
        last = rows.agg((F.max("ts") + F.make_dt_interval(F.lit(days))).alias("ts"))
        return last.select("ts", F.lit(MARKER).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("marker").alias("event_type"))

    return [rows, marker(1), marker(2), *([rows, marker(3)] if again else [])]


def without_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream whose rows come twice, the second time behind the watermark: they are dropped."""
    stream = in_steps(spark, _with_markers(spark, sf_dir, True))
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = drained(counts, "append").where("event_type <> 'marker'")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n")


def _profile() -> StatefulProcessor:
    """The processor of :func:`profiles`; made in a function, it travels by value and executors need not import this module."""

    class _Profile(StatefulProcessor):
        """Events so far (value state), the last three (list state) and counts by type (map state) of each user."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.total = handle.getValueState("total", "n long")
            self.last = handle.getListState("last", "event_id long")
            self.types = handle.getMapState("types", "event_type string", "n long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            n = self.total.get()[0] if self.total.exists() else 0
            last = [x[0] for x in self.last.get()] if self.last.exists() else []
            for pdf in rows:
                n += len(pdf)
                last = sorted([*last, *pdf["event_id"].tolist()])[-3:]
                for kind, many in pdf["event_type"].value_counts().items():
                    had = self.types.getValue((kind,))[0] if self.types.containsKey((kind,)) else 0
                    self.types.updateValue((kind,), (had + int(many),))
            self.total.update((n,))
            self.last.put([(x,) for x in last])
            kinds = ",".join(f"{k[0]}={v[0]}" for k, v in sorted(self.types.iterator()))
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [",".join(map(str, last))], "types": [kinds]})

        def close(self) -> None:
            pass

    return _Profile()


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the processor says last of each user."""
    schema = "user_id long, n long, last string, types string"
    with rocksdb(spark):
        rows = events(spark, sf_dir, None).select("user_id", "event_id", "event_type")
        made = rows.groupBy("user_id").transformWithStateInPandas(_profile(), schema, "Update", "None")
        return drained(made, "update").groupBy("user_id").agg(F.max_by(F.struct("n", "last", "types"), "n").alias("x")).select("user_id", "x.*")


def _farewell() -> StatefulProcessor:
    """The processor of :func:`farewells`."""

    class _Farewell(StatefulProcessor):
        """A row for each user an hour of event time after their last event, by a timer; then their state is gone."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "n long, last long, at long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            n, last, at = self.seen.get() if self.seen.exists() else (0, -1, 0)
            if at:
                self.handle.deleteTimer(at)
            for pdf in rows:
                n, last = n + len(pdf), max(last, int(pdf["event_id"].max()))
                at = max(at, int(pdf["ms"].max()) + 3_600_000)
            self.seen.update((n, last, at))
            self.handle.registerTimer(at)
            yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64"), "last_event": pd.Series([], dtype="int64")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            n, last, _ = self.seen.get()
            self.seen.clear()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_event": [last]})

        def close(self) -> None:
            pass

    return _Farewell()


def farewells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who have left, told by event-time timers."""
    with rocksdb(spark):
        stream = in_steps(spark, _with_markers(spark, sf_dir, False))
        rows = stream.select("user_id", "event_id", "ts", F.unix_millis("ts").alias("ms"))
        made = rows.groupBy("user_id").transformWithStateInPandas(_farewell(), "user_id long, n long, last_event long", "Append", "EventTime")
        return drained(made, "append").where(F.col("user_id") != MARKER)


def after_a_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type of a stream that stops half-way and goes on from its checkpoint."""
    base = scratch(spark, "restart")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    out: DataFrame | None = None
    for k in (0, 1):
        rows.where(F.col("event_id") % 2 == k).coalesce(1).write.parquet(f"{base}/in/{k}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in/*").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        out = drained(stream, "complete", f"{base}/run")
    return out


def in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory sink, for results of a bounded number of rows: counts by type."""
    name = f"memory_{uuid.uuid4().hex}"
    counts = events(spark, sf_dir, None).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    query = counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


#: How long state lives that isn't touched.
TTL_MS = 3000


def _forgetful() -> StatefulProcessor:
    """The processor of :func:`after_expiry`."""

    class _Forgetful(StatefulProcessor):
        """Events of each user since their state last expired."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "n long", ttlDurationMs=TTL_MS)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            n = self.seen.get()[0] if self.seen.exists() else 0
            n += sum(len(pdf) for pdf in rows)
            self.seen.update((n,))
            yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

        def close(self) -> None:
            pass

    return _Forgetful()


def until_idle(stream: DataFrame, path: str, seconds: float = 600) -> list[int]:
    """Run a stream in processing time until a batch finds no rows, and stop it; the numbers of its batches that had some.

    A stream with time to live never ends by itself: it goes on with batches without rows, to clear what expires.
    """
    batches: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/{batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").start()
    end = time.monotonic() + seconds
    try:
        while query.isActive and time.monotonic() < end:
            done = {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
            batches = sorted(b for b, n in done.items() if n)
            # a batch that was cut short by the last stop comes first and may have no rows either
            idle = [b for b, n in done.items() if n == 0 and b > max(batches, default=-1)]
            if len(idle) >= (1 if batches else 4):
                break
            time.sleep(0.1)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return batches


def after_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events since their state expired, as the stream says and as its state store has it: the first half of the events is forgotten."""
    base = scratch(spark, "ttl")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    with rocksdb(spark):
        for k in (0, 1):
            rows.where(F.col("event_id") % 2 == k).write.parquet(f"{base}/in/{k}")
            stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in/*")
            made = stream.groupBy("user_id").transformWithStateInPandas(_forgetful(), "user_id long, n long", "Update", "ProcessingTime")
            batches = until_idle(made, base)
            if k == 0:
                time.sleep(1.2 * TTL_MS / 1000)
        said = spark.read.schema("user_id long, n long").parquet(*[f"{base}/rows/{b}" for b in batches])
        said = said.groupBy("user_id").agg(F.max("n").alias("n"))
        store = spark.read.format("statestore").option("stateVarName", "seen").option("batchId", max(batches)).load(f"{base}/state")
        kept = store.select(F.col("key.user_id").alias("user_id"), F.col("value.value.n").alias("kept"))
        return said.join(kept, "user_id", "full")


def clicks_with_and_without_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left outer join of two streams: clicks with the same user's purchases within an hour, or, once the watermark has passed that hour, without.

    The rows that move the watermark are on both sides, as a condition would be applied before the watermark is taken.
    """
    stream = in_steps(spark, _with_markers(spark, sf_dir, True))
    clicks = stream.where("event_type IN ('click', 'marker')").select(F.col("user_id").alias("u"), F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    bought = stream.where("event_type IN ('purchase', 'marker')").select("user_id", "event_id", "ts")
    on = (F.col("u") == F.col("user_id")) & (F.col("ts") >= F.col("clicked")) & (F.col("ts") <= F.col("clicked") + F.expr("INTERVAL 1 HOUR"))
    made = clicks.join(bought, on, "left_outer").select(F.col("u").alias("user_id"), "click_id", "event_id")
    return drained(made, "append").where(F.col("user_id") != MARKER)


def kept_and_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream's metrics say of rows that come twice, the second time behind the watermark: kept, by an observed count, and dropped."""

    class Listener(StreamingQueryListener):
        def __init__(self) -> None:
            self.kept = self.dropped = 0
            self.ended = threading.Event()

        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            p = event.progress
            if "rows" in p.observedMetrics:
                self.kept += p.observedMetrics["rows"]["n"] or 0
            self.dropped += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

        def onQueryTerminated(self, event) -> None:
            self.ended.set()

    listener = Listener()
    stream = in_steps(spark, _with_markers(spark, sf_dir, True)).dropDuplicates(["event_id", "ts"])
    spark.streams.addListener(listener)
    try:
        drained(stream.observe("rows", F.count_if(F.col("event_id") >= 0).alias("n")), "append")
        listener.ended.wait(60)  # told after the fact, in order
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(listener.kept, listener.dropped)], "kept long, dropped long")


def at_the_rate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate source as a clock for a table: event k is let through at tick k, by a join of the stream with the table."""
    events_ = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    first, last = events_.agg(F.min("event_id"), F.max("event_id")).first() or (0, -1)
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", (last or 0) - (first or 0) + 1).option("numPartitions", 4).load()
    ticks = stream.select((F.col("value") + F.lit(first or 0)).alias("event_id"))
    return drained(ticks.join(events_, "event_id").select("event_id", "event_type"), "append", once=True)
