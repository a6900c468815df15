"""Aggregation and joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """Join on ``key`` with each key of ``large`` spread over ``salts`` tasks; ``small`` is repeated that often.

    For a many-to-one join whose large side has hot keys. ``how``: inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join is inner or left")
    dealt = large.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in large.columns]), F.lit(salts)))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(repeated, [key, "__salt"], how).drop("__salt")
