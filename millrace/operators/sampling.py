"""Samples of an exact size that any engine repeats: bottom-k by hash, by stratum, with priority weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_unit(*identity: str, seed: str) -> Column:
    """A number in (0, 1) from MD5 of seed and columns."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in identity])
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def bottom_k(df: DataFrame, k: int, identity: list[str], strata: list[str] | None = None, weight: str | None = None, seed: str = "sample", estimate: str = "estimate") -> DataFrame:
    """``k`` rows of each stratum (all, if fewer), those of least priority, which is the hash over the weight.

    ``estimate`` estimates a row's weight: sums of it over any subset of the sample estimate that subset's sum of weights without bias.
    Rows without positive weight aren't drawn. Each task passes on no more than k + 1 rows of a stratum.
    """
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    rows = df.where(w > 0).withColumn("__q", hashed_unit(*identity, seed=seed) / w)
    place = F.row_number().over(Window.partitionBy(*(strata or [])).orderBy("__q", *identity))
    first = rows.withColumn("__at", place).where(F.col("__at") <= k + 1)  # pruned before the exchange
    bar = F.max(F.when(F.col("__at") == k + 1, F.col("__q"))).over(Window.partitionBy(*(strata or [])))
    made = first.withColumn("__bar", bar).where(F.col("__at") <= k)
    return made.withColumn(estimate, F.coalesce(F.greatest(w, 1 / F.col("__bar")), w)).drop("__q", "__at", "__bar")
