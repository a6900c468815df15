"""Range (band) join on buckets instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The level of spans with an infinite bound.
ENDLESS = 9999


def range_join(points: DataFrame, spans: DataFrame, point: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with ``low <= point < high``. ``width``: of the smallest buckets, about a typical span.

    Buckets have levels, each twice as wide as the one below. A span is filed at the level
    whose buckets are as wide as itself or wider, so in two of them at most, however wide it is; a
    point is filed in one bucket of each level that spans use (the levels, at most about two
    thousand numbers, are looked up first). So the join is an equi-join. Spans with an infinite
    bound have a level of one bucket, where they meet every point. Rows with nulls or NaN match
    nothing, nor do spans whose high isn't above their low. Column names of the two sides must differ.
    """
    wide = high - low
    level = F.when(wide >= F.lit(float("inf")), F.lit(ENDLESS)).otherwise(F.greatest(F.lit(0), F.ceil(F.log2(wide / F.lit(width)))).cast("int"))
    real = (high > low) & ~F.isnan(low.cast("double")) & ~F.isnan(high.cast("double"))
    filed = spans.where(real).withColumn("__level", level)
    levels = [r[0] for r in filed.select("__level").distinct().collect()]

    def bucket(x: Column, at: Column) -> Column:
        return F.when(at == ENDLESS, F.lit(0).cast("long")).otherwise(F.floor(x / (F.lit(float(width)) * F.pow(F.lit(2.0), at))))

    at = filed.withColumn(
        "__b", F.explode(F.array_distinct(F.array(bucket(low, F.col("__level")), bucket(high, F.col("__level")))))
    )
    every = F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>")
    placed = points.where(~F.isnan(point.cast("double"))).withColumn("__level", F.explode(every))
    placed = placed.withColumn("__b", bucket(point, F.col("__level")))
    return placed.join(at, ["__level", "__b"]).where((point >= low) & (point < high)).drop("__level", "__b")
