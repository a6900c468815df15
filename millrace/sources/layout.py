"""Tables whose layout does work: partitioned ones that prune at run time, bucketed ones that join without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch_path


def partitioned(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write ``df`` with a folder for each value of ``by``, and read it back.

    Rows are first dealt by those columns and by a part of each value of its own, so that a value of a third of the rows is
    written by several tasks, and a task opens few files.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(4)))
    salted.repartition(parts, *by, "__part").drop("__part").write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``df`` has rows of; all others stay as they are. ``df`` must not read from ``path``."""
    with _setting(df.sparkSession, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        df.write.mode("overwrite").partitionBy(*by).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``key`` in the shared folder: joins and groupings by it need no exchange.

    Rows are dealt by the key first, so each bucket is one file. The table is of this session's catalog and named at random.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)
