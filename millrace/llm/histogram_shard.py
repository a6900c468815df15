"""Sharding by histogram sort.

Rows are ordered by (group, id) and cut into shards of near-equal bytes. Splitters come from
rounds of exact counts: each round counts bytes and rows of the cells between candidate
boundaries on all partitions, with each cell's least and greatest key, and only those few
sums reach the driver. A cell that holds a splitter's target byte is refined with probes
spread over its own key range, until a boundary lies within ``tolerance`` of the target or
the cell holds a single key. Rows then cross the network once, keyed by cell.

Equal groups are adjacent, yet a group larger than a shard is cut between ids, so a hot
group is spread. Cells, not shards, are what a task sorts: a cell over ``cell_rows`` (fewer for
wide rows) is refined as well, and slots follow from the cells' exact row counts, so a shard may
be far larger than a task. Boundaries number a constant times shards plus rows / ``cell_rows``:
some ten thousand for fifty billion rows, which the driver and each task hold.

Defined results: a null group or id orders before all others; rows equal in group and id
share a cell and are slotted in any order; shards may be empty if there are fewer keys than
shards; an empty table gives an empty result; further columns pass through, and those named
``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, without

PROBES, TOLERANCE, CELL_ROWS = 16, 0.002, 1 << 22
_LOW = -(1 << 63)


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that compare as the pair of signed numbers does."""
    out = np.empty((len(a), 2), ">u8")
    sign = np.uint64(1 << 63)
    out[:, 0] = a.astype(np.int64).view(np.uint64) ^ sign
    out[:, 1] = b.astype(np.int64).view(np.uint64) ^ sign
    return np.ascontiguousarray(out).view("S16").ravel()


def _edges(edges: list[int]) -> np.ndarray:
    return np.array([e.to_bytes(16, "big") for e in edges], "S16")


def _histogram(keys: DataFrame, edges: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, bytes, rows, least key, greatest key) of each cell with rows, in order."""
    shared = keys.sparkSession.sparkContext.broadcast(_edges(edges))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for pdf in batches:
            packed = _packed(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            order = np.argsort(packed, kind="stable")
            packed = packed[order]
            below = np.concatenate(([0], np.cumsum(pdf["size"].to_numpy()[order])))
            cuts = np.concatenate(([0], np.searchsorted(packed, shared.value, "left"), [len(packed)]))
            for cell in np.flatnonzero(cuts[1:] > cuts[:-1]):
                i, j = int(cuts[cell]), int(cuts[cell + 1])
                lo, hi = bytes(packed[i]).ljust(16, b"\0"), bytes(packed[j - 1]).ljust(16, b"\0")
                was = found.setdefault(int(cell), [0, 0, lo, hi])
                was[0] += int(below[j] - below[i])
                was[1] += j - i
                was[2], was[3] = min(was[2], lo), max(was[3], hi)
        rows = [(cell, *x) for cell, x in found.items()]
        yield pd.DataFrame(rows, columns=["cell", "bytes", "n", "lo", "hi"])

    merged = (
        keys.mapInPandas(count, "cell int, bytes long, n long, lo binary, hi binary")
        .groupBy("cell")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .collect()
    )
    shared.unpersist()
    return sorted(
        (r["cell"], r["bytes"], r["n"], int.from_bytes(r["lo"], "big"), int.from_bytes(r["hi"], "big")) for r in merged
    )


def _spread(lo: int, hi: int, probes: int) -> list[int]:
    """Boundaries within (lo, hi], evenly spread; at least one if lo < hi."""
    return sorted({lo + max(1, (hi - lo) * j // probes) for j in range(1, probes)}) if lo < hi else []


def splitters(
    keys: DataFrame, shards: int, tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS
) -> tuple[list[int], list[int], list[int]]:
    """Cell boundaries, and for each cell its shard and the slot of its first row. ``keys``: a, b, size."""
    edges: list[int] = []
    while True:
        cells = _histogram(keys, edges)
        m = len(edges) + 1
        size, rows, span = [0] * m, [0] * m, [(0, 0)] * m
        for cell, s, n, lo, hi in cells:
            size[cell], rows[cell], span[cell] = s, n, (lo, hi)
        below = [0, *accumulate(size)]
        total = below[-1]
        if not edges and cells and shards > 1:
            edges = _spread(*span[0], max(PROBES * shards, -(-2 * rows[0] // cell_rows)))
            if edges:
                continue
        slack = tolerance * total / shards
        refine, cut = {c for c in range(m) if rows[c] > cell_rows and span[c][0] < span[c][1]}, []
        for k in range(1, shards):
            target = total * k / shards
            cell = min(bisect_right(below, target) - 1, m - 1)
            near = min((cell, cell + 1), key=lambda c: abs(below[c] - target))
            cut.append(near)
            if abs(below[near] - target) > slack and span[cell][0] < span[cell][1]:
                refine.add(cell)
        if not refine:
            break
        edges = sorted({*edges, *(e for c in refine for e in _spread(*span[c], PROBES))})
    shard_of = [bisect_right(cut, c) for c in range(m)]
    first, slots = [], [0] * shards
    for c in range(m):
        first.append(slots[shard_of[c]])
        slots[shard_of[c]] += rows[c]
    return edges, shard_of, first


def shard(
    df: DataFrame,
    shards: int,
    group: str,
    ident: str,
    size: str,
    tolerance: float = TOLERANCE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``group`` and ``ident`` are long columns, ``size`` is a long column of bytes; a null size counts as 0.
    """
    base = without(df, [n for n in ("shard", "slot") if n not in {group, ident, size}])
    a, b = (F.coalesce(F.col(c).cast("long"), F.lit(_LOW)) for c in (group, ident))
    keys = materialise(
        base.select(a.alias("a"), b.alias("b"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")), "shard-keys"
    )
    edges, shard_of, first = splitters(keys, shards, tolerance, cell_rows)
    discard(keys)
    plan = df.sparkSession.sparkContext.broadcast((_edges(edges), np.array(shard_of, np.int32), np.array(first, np.int64)))

    @F.pandas_udf("cell int, shard int, first long")
    def place(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        bounds, to, start = plan.value
        cell = np.searchsorted(bounds, _packed(x.to_numpy(), y.to_numpy()), "right")
        return pd.DataFrame({"cell": cell.astype(np.int32), "shard": to[cell], "first": start[cell]})

    placed = base.withColumn("__at", place(a, b))
    rank = F.row_number().over(Window.partitionBy("__at.cell").orderBy(a, b))
    return placed.withColumns(
        {"shard": F.col("__at.shard"), "slot": F.col("__at.first") + rank - F.lit(1)}
    ).drop("__at")
