"""As-of join: for each left row the latest right row of its key at or before its time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    take: dict[str, str],
    strict: bool = False,
    block: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``left`` with the columns ``take`` (result name: right column) of the matching right row, or null.

    Both sides are united and shuffled once by key; a running ``last`` carries the right row
    forward. Rows with a null key or time match nothing and aren't shuffled. With ``strict`` the right row must be
    earlier. Of right rows at the same time, that with the greatest taken values is matched.
    Columns of ``left`` named like a taken one are replaced.

    ``block`` cuts the history of a hot key: a function of the time that never falls as time
    rises, such as the day. Each block of a key is then a task's work of its own, and only
    the last right row of each block is carried from block to block.
    """
    payload = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(take.values())])
    rights = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(key).alias("__k"), F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), payload.alias("__r")
    )
    usable = F.col(key).isNotNull() & F.col(left_time).isNotNull()
    new = {name.lower() for name in take}
    kept = [c for c in left.columns if c.lower() not in new]
    # rows that can match nothing stay where they are: a null key may be that of most rows
    types = {name: right.schema[c].dataType for name, c in take.items()}
    unmatched = left.where(~usable).select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast(t).alias(name) for name, t in types.items()])
    lefts = left.where(usable).select(
        F.col(key).alias("__k"),
        F.col(left_time).alias("__t"),
        F.lit(0 if strict else 1).alias("__side"),
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"),
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    if block:
        both, rights = (x.withColumn("__b", block(F.col("__t"))) for x in (both, rights))
    w = Window.partitionBy("__k", *(["__b"] if block else [])).orderBy("__t", "__side", F.col("__r").asc_nulls_first())
    found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.where(F.col("__l").isNotNull())
    if block:
        # each block's last right row, valid until the next block that has one
        ends = rights.groupBy("__k", "__b").agg(F.max("__r").alias("__r"))
        starts = both.select("__k", "__b").distinct().join(ends, ["__k", "__b"], "left")
        earlier = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = starts.withColumn("__c", F.last("__r", ignorenulls=True).over(earlier)).select("__k", "__b", "__c")
        found = found.join(carried, ["__k", "__b"], "left").withColumn("__m", F.coalesce("__m", "__c"))
    made: list[Column] = [F.col("__m")[f"c{i}"].alias(name) for i, name in enumerate(take)]
    return found.select(*[F.col(f"__l.`{c}`") for c in kept], *made).unionByName(unmatched)
