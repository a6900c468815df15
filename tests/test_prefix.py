from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.prefix import prefix_scan


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_same_as_plain_windows(spark, keys):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("g"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 37) % 101).alias("a"), "id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"),
    )
    got = prefix_scan(
        rows, ["-a", "id"], keys, number="n", total="t", sums={"s": F.col("v"), "d": F.col("v").cast("decimal(9,2)")},
        lags={"p": (F.col("v"), 1), "q": (F.col("id"), 9)}, tiles={"k": 7, "m": 600}, parts=9,
    )
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("a"), "id")
    upto, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    want = rows.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.count(F.lit(1)).over(every).alias("t"), F.sum("v").over(upto).alias("s"),
        F.sum(F.col("v").cast("decimal(9,2)")).over(upto).alias("d"), F.lag("v", 1).over(w).alias("p"), F.lag("id", 9).over(w).alias("q"),
        F.ntile(7).over(w).alias("k"), F.ntile(600).over(w).alias("m"),
    )
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "SinglePartition" not in got._jdf.queryExecution().toString() or keys


def test_ranges_stay_small_and_empty_tables_stay_empty(spark):
    rows = spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("n"))
    got = prefix_scan(rows, ["n"], ["g"], number="N", parts=8)
    assert got.columns == ["g", "N"]
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 4000 / 8
    assert prefix_scan(rows.limit(0), ["n"], number="r").count() == 0
