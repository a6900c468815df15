"""Exact top-k by inner product as a Voronoi kNN join.

Largest inner product is made nearest distance by one more component: x becomes
(x, sqrt(M^2 - |x|^2)) with M the greatest norm, and a query q becomes (q, 0), so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x.

Data and queries are assigned to the nearest of a bounded number of pivots. Each query has a
proven radius: the k-th best product with a bounded sample of the data, which the whole data
can only better. For the queries of a cell and a data cell with pivot p, a vector at distance d
from p can be needed by query q only if |q' - p| - radius <= d <= |q' - p| + radius, hence only
if d lies between the least and the greatest of these. Those bounds are the summary: pivots
times pivots numbers, and with them a histogram of each data cell's distances.

Neighbouring query cells become one group where the summaries say that moving the data once
to both costs less than what one must then score in vain. Data go to the groups that may need
them, and nowhere else. Groups are cut into blocks of queries; data cells are packed into parts
of about ``chunk`` vectors (a larger cell is cut by key), and queries go only to parts with a
cell they may need, so a task's share is bounded however many fall into one cell.

How much this spares depends on the data. Directions without clusters, in 64 dimensions, are
all about as far from each other as from a pivot: there the bounds exclude nothing and each
group gets all vectors, as in a scan by blocks of queries. On clustered vectors most are spared.

See :mod:`vectors` for which vectors take part. Products are exact while their partial sums
stay below 2^53. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best, distinct_vectors, encoded, matrix, ranked, valid

PIVOTS, SEEDS, BLOCK, CHUNK = 256, 2048, 2048, 16_384
#: Steps of a data cell's histogram; moving a vector costs about as much as scoring it this often.
STEPS, MOVE = 64, 128
#: Added to distances so that rounding never excludes a vector.
EPS = 1e-6


def _augmented(x: np.ndarray, m2: float | None) -> np.ndarray:
    more = np.zeros(len(x)) if m2 is None else np.sqrt(np.maximum(0.0, m2 - (x * x).sum(axis=1)))
    return np.concatenate((x, more[:, None]), axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


class Plan:
    """Groups of query cells with their bounds, and parts of data cells; its size depends on the pivots only."""

    def __init__(self, pivots: np.ndarray, asked: np.ndarray, lo: np.ndarray, hi: np.ndarray, spread: np.ndarray, step: float, block: int, chunk: int) -> None:
        # spread: how many vectors of each data cell are at a distance of each step
        edges = np.arange(spread.shape[1]) * step
        # a step too many at either end: estimates may exceed what is needed, never fall below
        need = lambda lo, hi: np.where((edges[None, :] + 2 * step >= lo[:, None]) & (edges[None, :] - step <= hi[:, None]), spread, 0).sum(axis=1)
        centred = pivots - pivots.mean(axis=0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
        groups: list[list] = []  # cells, queries, lo, hi, vectors needed
        for cell in np.argsort(along, kind="stable").tolist():
            if not asked[cell]:
                continue
            new = [[cell], int(asked[cell]), lo[cell], hi[cell], int(need(lo[cell], hi[cell]).sum())]
            if groups and groups[-1][1] + new[1] <= block:
                old = groups[-1]
                low, high = np.minimum(old[2], new[2]), np.maximum(old[3], new[3])
                both, n = old[1] + new[1], int(need(low, high).sum())
                if n * (MOVE + both) <= old[4] * (MOVE + old[1]) + new[4] * (MOVE + new[1]):
                    groups[-1] = [old[0] + [cell], both, low, high, n]
                    continue
            groups.append(new)
        self.group = np.zeros(len(pivots), np.int64)
        for g, (cells, *_) in enumerate(groups):
            self.group[cells] = g
        self.blocks = np.array([max(1, -(-g[1] // block)) for g in groups], np.int64)
        self.lo, self.hi = np.array([g[2] for g in groups]), np.array([g[3] for g in groups])
        # data cells to parts
        held = spread.sum(axis=1)
        self.many = np.maximum(1, -(-held // chunk))
        self.first = np.zeros(len(pivots), np.int64)
        at = room = 0
        for cell in np.argsort(along, kind="stable").tolist():
            n, many = int(held[cell]), int(self.many[cell])
            if room and (many > 1 or room + n > chunk):
                at, room = at + 1, 0
            self.first[cell] = at
            at, room = (at + many, 0) if many > 1 else (at, room + n)
        self.wanted = []
        for g in groups:
            cells = np.flatnonzero(need(g[2], g[3]))
            parts = [np.arange(self.first[c], self.first[c] + self.many[c]) for c in cells.tolist()]
            self.wanted.append(np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64))


def top_k(
    df: DataFrame,
    ident: str,
    vector: str,
    queries: Column,
    k: int = 20,
    pivots: int = PIVOTS,
    seeds: int = SEEDS,
    block: int = BLOCK,
    chunk: int = CHUNK,
    scale: float | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query. ``queries``: a condition on ``id``.

    With ``scale``, components become floor(scale * x) first.
    """
    rows = valid(df, ident, vector)
    if scale is not None:
        rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))
    table, asked = distinct_vectors(encoded(rows, queries), k)
    made = dealt(table, k, pivots, seeds, block, chunk)
    if made is None:
        return ranked(df.sparkSession.createDataFrame([], "key long, id long, score double"), asked, k)
    data, sought = made

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"key": [], "id": [], "score": []})
        found = best(q["key"].tolist(), matrix(q["vec"]), matrix(x["vec"]), x["ids"].tolist(), k + 1, 1e-12)
        return pd.DataFrame(dict(zip(("key", "id", "score"), found, strict=True)))

    on = ["g", "y", "part"]
    found = sought.groupBy(*on).cogroup(data.groupBy(*on)).applyInPandas(solve, "key long, id long, score double")
    return ranked(found, asked, k)


def dealt(table: DataFrame, k: int, pivots: int, seeds: int, block: int, chunk: int) -> tuple[DataFrame, DataFrame] | None:
    """(g, y, part, vec, ids) of data and (g, y, part, key, vec) of queries: what meets in one task. None without data."""
    sc = table.sparkSession.sparkContext
    sample = matrix([r["vec"] for r in table.orderBy("key", "vec").select("vec").limit(max(pivots, seeds)).collect()] or [b""])
    if not sample.size:
        return None

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                yield pa.RecordBatch.from_pydict({"m": [float((x * x).sum(axis=1).max())]})

    m2 = table.select("vec").mapInArrow(norms, "m double").agg(F.max("m")).first()[0]
    centre = _augmented(sample[:pivots], m2)
    step = max(2 * float(np.sqrt(m2)), 1e-300) / STEPS
    shared = sc.broadcast((centre, sample[:seeds]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value[0]
        counts = np.zeros((2, len(p), STEPS + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x, asked = matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                d = _distances(_augmented(x, m2), p)
                cell = d.argmin(axis=1)
                at = np.minimum(d[np.arange(len(d)), cell] / step, STEPS).astype(np.int64)
                np.add.at(counts[0], (cell, at), 1)
                np.add.at(counts[1], (_distances(_augmented(x[asked], None), p).argmin(axis=1), 0), 1)
        which, cell, at = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"which": which.astype(np.int32), "cell": cell.astype(np.int32), "at": at.astype(np.int32), "n": counts[which, cell, at]}
        )

    counts = np.zeros((2, len(centre), STEPS + 1), np.int64)
    sums = table.select("vec", "q").mapInArrow(spread, "which int, cell int, at int, n long").groupBy("which", "cell", "at").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # pivots times steps numbers
        counts[r["which"], r["cell"], r["at"]] = r["n"]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known = shared.value
        lo, hi = np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                x = matrix(b.column(0).slice(a, 2048))
                d = _distances(_augmented(x, None), p)
                to = d.argmin(axis=1)
                if len(known) > k:
                    kth = np.partition(x @ known.T, -(k + 1), axis=1)[:, -(k + 1)]
                    radius = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1) + m2 - 2 * kth))
                    slack = EPS * (1 + np.sqrt(m2) + radius)
                else:
                    radius, slack = np.full(len(x), np.inf), np.zeros(len(x))
                np.minimum.at(lo, to, d - (radius + slack)[:, None])
                np.maximum.at(hi, to, d + (radius + slack)[:, None])
        for g in np.flatnonzero((lo < np.inf).any(axis=1)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(g)], pa.int32()), pa.array([lo[g].tobytes()], pa.binary()), pa.array([hi[g].tobytes()], pa.binary())],
                names=["g", "lo", "hi"],
            )

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = np.min([np.frombuffer(x) for x in pdf["lo"]], axis=0)
        hi = np.max([np.frombuffer(x) for x in pdf["hi"]], axis=0)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "lo": [lo.tobytes()], "hi": [hi.tobytes()]})

    shape = "g int, lo binary, hi binary"
    asked_vectors = table.where("q").select("key", "vec")
    lo, hi = np.full((len(centre), len(centre)), np.inf), np.full((len(centre), len(centre)), -np.inf)
    for r in asked_vectors.select("vec").mapInArrow(bounds, shape).groupBy("g").applyInPandas(least, shape).collect():
        lo[r["g"]], hi[r["g"]] = np.frombuffer(r["lo"]), np.frombuffer(r["hi"])
    plan = sc.broadcast(Plan(centre, counts[1].sum(axis=1), lo, hi, counts[0], step, block, chunk))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Data vectors, for each block of each group that may need them."""
        p, own = shared.value[0], plan.value
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(_augmented(matrix(b.column(1)), m2), p)
            cell = d.argmin(axis=1)
            d = d[np.arange(len(d)), cell]
            part = own.first[cell] + (b.column(0).to_numpy().view(np.uint64) % own.many[cell].astype(np.uint64)).astype(np.int64)
            for g in range(len(own.blocks)):
                at = np.flatnonzero((d >= own.lo[g, cell]) & (d <= own.hi[g, cell]))
                for y in range(int(own.blocks[g]) if len(at) else 0):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, z, np.int32)) for z in (g, y)]
                        + [pa.array(part[at].astype(np.int32)), b.column(1).take(at), b.column(2).take(at)],
                        names=["g", "y", "part", "vec", "ids"],
                    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, for each part that may hold what they need."""
        p, own = shared.value[0], plan.value
        for b in batches:
            if not b.num_rows:
                continue
            g = own.group[_distances(_augmented(matrix(b.column(1)), None), p).argmin(axis=1)]
            y = b.column(0).to_numpy().view(np.uint64) // np.uint64(7919) % own.blocks[g].astype(np.uint64)
            for x in np.unique(g).tolist():
                at = np.flatnonzero(g == x)
                for part in own.wanted[x].tolist():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), x, np.int32)), pa.array(y[at].astype(np.int32)), pa.array(np.full(len(at), part, np.int32)),
                            b.column(0).take(at), b.column(1).take(at),
                        ],
                        names=["g", "y", "part", "key", "vec"],
                    )

    data = table.select("key", "vec", "ids").mapInArrow(replicate, "g int, y int, part int, vec binary, ids array<long>")
    return data, asked_vectors.mapInArrow(ask, "g int, y int, part int, key long, vec binary")
