"""Structured Streaming over the ``events`` table: each query runs to the end of its input and returns the sink's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources.scratch import scratch_path


def events(spark: SparkSession, sf_dir: str, watermark: str | None = "10 minutes") -> DataFrame:
    """The events file as a stream, its time as an instant in UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", watermark) if watermark else stream


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the shared folder, deleted when the application ends."""
    return scratch_path(spark, f"stream-{tag}")


def drained(stream: DataFrame, mode: str, path: str | None = None, once: bool = False) -> DataFrame:
    """Run a stream until its input is used up and return what it wrote to the shared folder.

    Each micro-batch is a folder of its own, overwritten if the batch is run again; in complete
    mode only the last one counts. ``path``: where rows and state go; a stream with the state of
    an earlier run goes on from there, and only this run's rows are returned. ``once``: one micro-batch.
    """
    spark = stream.sparkSession
    path, batches = path or scratch(spark, "run"), []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/{batch}")
        batches.append(batch)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state")
    query = (writer.trigger(once=True) if once else writer.trigger(availableNow=True)).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    wanted = batches[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/rows/{b}" for b in wanted])


def windowed(spark: SparkSession, sf_dir: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and value sums by event type in tumbling or sliding windows."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events(spark, sf_dir).groupBy(span.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total")
    )
    return drained(rows, "complete").select(
        F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total"
    )


def sessions(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    """Sessions of each user: a new one after a pause of at least ``gap``."""
    rows = events(spark, sf_dir).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return drained(rows, "complete").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user_id, event_type); state is kept for as long as the watermark allows."""
    rows = events(spark, sf_dir, "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return drained(rows.select("user_id", "event_type"), "append")


def purchases_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream join: purchases within an hour of the same user's click."""
    clicks = events(spark, sf_dir).where("event_type = 'click'").select(
        F.col("user_id").alias("u"), F.col("event_id").alias("click_id"), F.col("ts").alias("clicked")
    )
    bought = events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    on = (F.col("u") == F.col("user_id")) & (F.col("ts") >= F.col("clicked")) & (F.col("ts") <= F.col("clicked") + F.expr("INTERVAL 1 HOUR"))
    return drained(clicks.join(bought, on).select("user_id", "click_id", "event_id"), "append")


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state by user: events so far and the greatest id, in pandas."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1)
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf["event_id"].max()))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_event": [last]})

    rows = events(spark, sf_dir, None).select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(
        step, "user_id long, n long, last_event long", "n long, last long", "update", GroupStateTimeout.NoTimeout
    )
    out = drained(rows, "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max("last_event").alias("last_event"))


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream to its end, giving each micro-batch and its number to ``write``."""
    query = stream.writeStream.foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
