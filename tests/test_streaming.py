from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.streaming import drained, each_batch


def _write(spark, folder, n, rows):
    spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(f"{folder}/{n}")


def test_late_rows_are_dropped_once_the_watermark_has_moved(spark, tmp_path):
    noon = dt.datetime(2024, 1, 1, 12)
    steps = [[(noon, "a")], [(noon + dt.timedelta(hours=3), "a")], [(noon + dt.timedelta(hours=3), "b")], [(noon, "late")]]
    for n, rows in enumerate(steps):
        _write(spark, tmp_path, n, rows)
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    rows = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "k").count()
    got = {(r.k, r["count"]) for r in drained(rows.select("k", "count"), "append").collect()}
    assert ("a", 1) in got and not any(k == "late" for k, _ in got)


def test_append_mode_needs_a_watermark(spark, tmp_path):
    _write(spark, tmp_path, 0, [(dt.datetime(2024, 1, 1), "a")])
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/*")
    with pytest.raises(AnalysisException):
        drained(stream.groupBy("k").count(), "append")


def test_foreach_batch_sees_all_rows(spark, tmp_path):
    _write(spark, tmp_path, 0, [(dt.datetime(2024, 1, 1), "a"), (dt.datetime(2024, 1, 2), "b")])
    seen = []
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/*")
    each_batch(stream, lambda df, _: seen.append(df.count()))
    assert sum(seen) == 2
