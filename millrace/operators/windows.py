"""Window operations beyond Spark's own syntax: QUALIFY, GROUPS frames and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark prunes groups map-side (window group limit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def groups_frame(df: DataFrame, group: list[str], order: str, before: int, after: int, made: dict[str, Column]) -> DataFrame:
    """Aggregates over a GROUPS frame: peers count once. A dense rank turns it into a RANGE frame."""
    ranked = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*group).orderBy(order)))
    w = Window.partitionBy(*group).orderBy("__peer").rangeBetween(-before, after)
    return ranked.withColumns({name: c.over(w) for name, c in made.items()}).drop("__peer")


def sessions(df: DataFrame, key: str, time: str, gap: str, name: str = "session") -> DataFrame:
    """Number each key's sessions from 0: a new one begins after a pause longer than ``gap``, an interval."""
    w = Window.partitionBy(key).orderBy(time)
    fresh = (F.col(time) > F.lag(time).over(w) + F.expr(f"INTERVAL {gap}")).cast("long")
    return df.withColumn("__new", F.coalesce(fresh, F.lit(0))).withColumn(name, F.sum("__new").over(w)).drop("__new")
