"""What the two vector searches share: which vectors take part, distinct vectors, and merging top lists.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
with a null id or vectors of another length than the commonest (the longest of those, in a
tie). Rows equal in id and vector count once. An id with several vectors is as many
candidates, and none of them is a candidate of its own queries.

Equal vectors are searched once. A list of k needs at most k + 1 ids of a vector, the smallest
(one may be the query's own), so a vector of a third of all rows costs no more than another;
the window that keeps those ids is pruned map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

INF = float("inf")


def valid(df: DataFrame, ident: str, vector: str, nonzero: bool = False) -> DataFrame:
    """(id, v: array of double) of the rows that take part."""
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF)))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def encoded(rows: DataFrame, queries: Column) -> DataFrame:
    """(id, q, vec): vectors as 8-byte floats in binary; -0.0 is made 0.0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) + 0.0
            vec = [r.tobytes() for r in np.ascontiguousarray(flat, "<f8")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(vec, pa.binary())], names=["id", "q", "vec"])

    return rows.select("id", "v", queries.alias("q")).mapInArrow(run, "id long, q boolean, vec binary")


def distinct_vectors(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """From (id, q, vec): (key, vec, ids, q), one row a vector, and (qid, key) of each query; both materialised.

    ``key`` is a 64-bit hash of the vector.
    """
    w = Window.partitionBy("vec").orderBy("id")
    some = (
        rows.select("vec", "id")
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= k + 1)
        .groupBy("vec")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )
    asked = rows.where("q").select("vec", F.col("id").alias("qid")).distinct()
    wanted = asked.select("vec").distinct().withColumn("q", F.lit(True))
    table = materialise(
        some.join(wanted, "vec", "left").select(
            F.xxhash64("vec").alias("key"), "vec", "ids", F.coalesce("q", F.lit(False)).alias("q")
        ),
        "vectors",
    )
    return table, materialise(asked.select("qid", F.xxhash64("vec").alias("key")), "queries")


def matrix(column: pa.Array) -> np.ndarray:
    data = column.to_pylist() if isinstance(column, pa.Array | pa.ChunkedArray) else list(column)
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)


def best(keys, queries: np.ndarray, vecs: np.ndarray, ids: list, k: int, slack: float) -> tuple[list, list, list]:
    """For each query the k best (key, id, score) by score and then id, each vector standing for its ids.

    ``slack``: scores this much (relative) below the k-th are looked at again with sums in fixed order.
    """
    out_key, out_id, out_score = [], [], []
    if not len(vecs):
        return out_key, out_id, out_score
    many = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.asarray(x, np.int64) for x in ids])
    start = np.concatenate(([0], np.cumsum(many)))
    for a in range(0, len(queries), 128):
        block = queries[a : a + 128]
        scores = block @ vecs.T
        kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else scores.min(axis=1)
        rows, cols = np.nonzero(scores >= (kth - slack * (1 + np.abs(kth)))[:, None])
        bounds = np.searchsorted(rows, np.arange(len(block) + 1))
        for i in range(len(block)):
            c = cols[bounds[i] : bounds[i + 1]]
            exact = (vecs[c] * block[i]).sum(axis=1)
            each = np.repeat(exact, many[c])
            at = np.concatenate([flat[start[x] : start[x + 1]] for x in c])
            order = np.lexsort((at, -each))[:k]
            out_key += [keys[a + i]] * len(order)
            out_id.append(at[order])
            out_score.append(each[order])
    return out_key, np.concatenate(out_id).tolist(), np.concatenate(out_score).tolist()


def ranked(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(key, id, score) of partial lists to (query_id, rank, vec_id, score): the k best other than the query's own id."""
    w = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    lists = (
        found.distinct()
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= k + 1)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "id", "score"))).alias("list"))
    )
    own = F.slice(F.filter("list", lambda r: r["id"] != F.col("qid")), 1, k)
    return (
        asked.join(lists, "key")
        .select(F.col("qid").alias("query_id"), F.posexplode(own).alias("at", "r"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("r.id").alias("vec_id"), F.col("r.score").alias("score"))
    )
