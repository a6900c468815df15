"""Functions beyond the built-in ones, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(x: Column) -> Column:
    """Skewness with the sample correction, null under three values; Spark's own is the population's."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Excess kurtosis with the sample correction, null under four values; Spark's own is the population's."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def round_half_up(x: Column, digits: int) -> Column:
    """A double rounded by way of decimals, so that what prints as a half is one."""
    return F.round(x.cast("decimal(18,6)"), digits).cast("double")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in doubles, from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
