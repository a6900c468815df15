"""Sketches read back: point estimates and merging of count-min sketches, and exact heavy hitters by bounded summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole-number hashes of Spark's sketches are taken modulo this.
_PRIME = (1 << 31) - 1


class CountMin:
    """A sketch as ``count_min_sketch`` writes it: version, total, depth, width, a multiplier a row, then counters, big-endian."""

    def __init__(self, raw: bytes) -> None:
        version, self.total, depth, width = (int(x) for x in np.frombuffer(raw[:20], np.dtype([("v", ">i4"), ("n", ">i8"), ("d", ">i4"), ("w", ">i4")]))[0])
        if version != 1:
            raise ValueError(f"count-min sketches of version {version} are not known")
        self.by = np.frombuffer(raw, ">i8", depth, 20).astype(np.int64)
        self.table = np.frombuffer(raw, ">i8", depth * width, 20 + 8 * depth).astype(np.int64).reshape(depth, width)

    def merged(self, other: CountMin) -> CountMin:
        """The sketch of both inputs; they must come from the same error, confidence and seed."""
        if self.table.shape != other.table.shape or (self.by != other.by).any():
            raise ValueError("only sketches of the same error, confidence and seed can be merged")
        self.table, self.total = self.table + other.table, self.total + other.total
        return self

    def raw(self) -> bytes:
        depth, width = self.table.shape
        head = np.array([(1, self.total, depth, width)], np.dtype([("v", ">i4"), ("n", ">i8"), ("d", ">i4"), ("w", ">i4")]))
        return head.tobytes() + self.by.astype(">i8").tobytes() + self.table.astype(">i8").tobytes()

    def estimates(self, items: np.ndarray) -> np.ndarray:
        """For whole numbers: never below the true count, above it by more than error times total only if the sketch fails."""
        out = None
        for by, row in zip(self.by, self.table, strict=True):
            with np.errstate(over="ignore"):
                h = by * items.astype(np.int64)
                h = h + (h >> 32)
            x = row[(h & _PRIME) % len(row)]
            out = x if out is None else np.minimum(out, x)
        return out


def count_min_merge(sketches: str | Column) -> Column:
    """Aggregate: one sketch of a column of sketches, such as one a day."""

    @F.pandas_udf("binary")
    def merge(raws: pd.Series) -> bytes:
        made = None
        for raw in raws:
            if raw is not None:
                made = CountMin(bytes(raw)) if made is None else made.merged(CountMin(bytes(raw)))
        return made.raw() if made else None

    return merge(sketches)


def count_min_estimate(sketch: str | Column, item: str | Column) -> Column:
    """The estimated count of a whole number in the sketch beside it; null where either is null."""

    @F.pandas_udf("long")
    def estimate(raws: pd.Series, items: pd.Series) -> pd.Series:
        known: dict[bytes, CountMin] = {}
        out = []
        for raw, x in zip(raws, items, strict=True):
            if raw is None or pd.isna(x):
                out.append(None)
                continue
            raw = bytes(raw)
            if raw not in known:
                known.clear()
                known[raw] = CountMin(raw)
            out.append(int(known[raw].estimates(np.array([x], np.int64))[0]))
        return pd.Series(out, dtype="Int64")

    return estimate(sketch, item)


def heavy_hitters(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n): every key of more than ``share`` of the rows, with its exact count; nulls don't count as a key.

    A first pass keeps space-saving summaries of 2 / share counters a task: what a key may have lost in a task is at most the
    task's rows times share / 2, so the sums of counts and possible losses name every heavy key, and few
    others. A second pass counts those exactly. Memory and what is exchanged depend on the share alone.
    """
    most = max(1, int(np.ceil(2 / share)))
    kind = df.schema[key].dataType
    total = df.count()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = pd.Series(dtype="int64"), 0
        for b in batches:
            counts = pd.Series(b.column(0).to_pylist(), dtype="object").value_counts(dropna=True)
            held = held.add(counts, fill_value=0).astype("int64") if len(held) else counts
            if len(held) > most:  # the weakest go: all counters fall by the greatest of those that do
                cut = int(np.partition(held.to_numpy(), -most - 1)[-most - 1])
                held = held[held > cut] - cut
                lost += cut
        rows = [{"key": k, "n": int(n), "lost": lost} for k, n in held.items()] + [{"key": None, "n": 0, "lost": lost}]
        yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_type

    out_schema = pa.schema([("key", to_arrow_type(kind)), ("n", pa.int64()), ("lost", pa.int64())])
    parts = df.select(F.col(f"`{key}`")).mapInArrow(summarise, f"key {kind.simpleString()}, n long, lost long")
    # a task that doesn't name a key may have lost it: its bound is that of all tasks together
    sums = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    slack = F.broadcast(sums.where("key IS NULL").select(F.col("lost").alias("slack")))  # one row
    names = sums.where("key IS NOT NULL").join(slack, F.col("n") + F.col("slack") > F.lit(float(share * total))).select("key")
    return df.select(F.col(f"`{key}`").alias("key")).join(names, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(float(share * total))).withColumnRenamed("key", key)
