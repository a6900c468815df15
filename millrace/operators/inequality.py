"""Join on two inequalities without a nested loop: IEJoin on range blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import written

BLOCK_ROWS = 2048
_DOWN = {">": "<", ">=": "<="}


def matches(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray, strict: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with x1[i] < y1[j] and x2[i] < y2[j], or <= where not strict.

    The right side is put in order of its second value. The left side is taken in falling order of its first value, so
    the right rows that meet the first condition only grow: they are marked in a bit array by their place in that
    order, and the marks from a left row's second value on are its matches.
    """
    by_second = np.argsort(y2, kind="stable")
    second = y2[by_second]
    place = np.empty(len(y2), np.int64)  # the permutation from the order of first values to that of second ones
    by_first = np.argsort(-y1, kind="stable")
    place[:] = np.argsort(by_second, kind="stable")[by_first]
    marks = np.zeros(len(y2), bool)
    order = np.argsort(-x1, kind="stable")
    # right rows whose first value is greater than (or equal to) each left row's
    upto = len(y1) - np.searchsorted(np.sort(y1), x1[order], "right" if strict[0] else "left")
    start = np.searchsorted(second, x2[order], "right" if strict[1] else "left")
    left, right, done = [], [], 0
    for i, n, s in zip(order.tolist(), upto.tolist(), start.tolist(), strict=True):
        if n > done:
            marks[place[done:n]] = True
            done = n
        hit = np.flatnonzero(marks[s:])
        if len(hit):
            left.append(np.full(len(hit), i))
            right.append(by_second[hit + s])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _numbers(c: pa.ChunkedArray, flip: bool) -> np.ndarray:
    """Values as numbers that compare alike; negated where the condition is turned round."""
    kind = c.type
    if pa.types.is_timestamp(kind):
        c = c.cast(pa.timestamp("us", kind.tz)).cast(pa.int64())
    elif pa.types.is_date(kind):
        c = c.cast(pa.int32()).cast(pa.int64())
    elif not (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        raise TypeError(f"values of type {kind} can't be compared here")
    out = c.combine_chunks().to_numpy(zero_copy_only=False)
    out = out.astype(np.float64) if out.dtype.kind == "f" else out.astype(np.int64)
    return ~out if flip and out.dtype.kind == "i" else -out if flip else out  # ~ is monotone as - is, and can't overflow


def ie_join(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of rows that meet both conditions, each (left column, <, <=, > or >=, right column).

    Both sides are dealt by ranges of their first column into blocks of about ``block_rows``, written, and their least and
    greatest values looked up. Which blocks can match is again a join on two inequalities, of those few
    numbers on the driver (two numbers a block and side); only those pairs of blocks meet, and within
    them the pairs of rows are found by two sort orders, a permutation and a bit array. So the work follows the pairs of blocks
    that overlap, in place of all pairs of rows. Columns are numbers, dates or timestamps, compared within one type; rows
    with a null or NaN in a column of the conditions match nothing. Column names of the two sides must differ.
    """
    sides, stats = [], []
    for df, columns in ((left, (first[0], second[0])), (right, (first[2], second[2]))):
        fine = [F.col(f"`{c}`").isNotNull() & (~F.isnan(F.col(f"`{c}`")) if df.schema[c].dataType.typeName() in ("double", "float") else F.lit(True)) for c in columns]
        usable = df.where(fine[0] & fine[1])
        blocks = max(1, -(-usable.count() // block_rows))
        cut = usable.repartitionByRange(blocks, *[F.col(f"`{c}`") for c in columns]).withColumn("__block", F.spark_partition_id())
        table = written(cut, "ie-blocks")
        ends = [f(F.col(f"`{c}`")).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("lo", F.min), ("hi", F.max))]
        sides.append(table)
        stats.append(table.groupBy("__block").agg(*ends).toArrow())

    spark = left.sparkSession
    ops = (first[1], second[1])
    flips, strict = [op in _DOWN for op in ops], tuple(_DOWN.get(op, op) == "<" for op in ops)
    low = [_numbers(stats[0][f"{'hi' if f else 'lo'}{i}"], f) for i, f in enumerate(flips)]  # least left values, after turning
    high = [_numbers(stats[1][f"{'lo' if f else 'hi'}{i}"], f) for i, f in enumerate(flips)]
    a, b = matches(*low, *high, strict)
    pairs = pa.table({"__a": stats[0]["__block"].combine_chunks().take(pa.array(a)), "__b": stats[1]["__block"].combine_chunks().take(pa.array(b)), "__pair": pa.array(np.arange(len(a)))})
    own, other = left.columns, right.columns

    def solve(t: pa.Table, u: pa.Table) -> pa.Table:
        values = [_numbers(t[c], f) for c, f in zip((first[0], second[0]), flips, strict=True)]
        values += [_numbers(u[c], f) for c, f in zip((first[2], second[2]), flips, strict=True)]
        i, j = matches(*values, strict)
        made = [t[c].take(pa.array(i)) for c in own] + [u[c].take(pa.array(j)) for c in other]
        return pa.table(made, names=[*own, *other])

    schema = left.limit(0).join(right.limit(0), F.lit(True)).schema
    for f in schema:
        f.nullable = True
    data = []
    for side, c in zip(sides, ("__a", "__b"), strict=True):  # a table each, so that their columns are told apart
        met = spark.createDataFrame(pairs.select([c, "__pair"]).rename_columns(["__block", "__pair"]))
        data.append(side.join(met, "__block").drop("__block"))
    return data[0].groupBy("__pair").cogroup(data[1].groupBy("__pair")).applyInArrow(solve, schema)
