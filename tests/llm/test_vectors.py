from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import cross_polytope, vectors, voronoi_knn
from millrace.llm.queries import ORACLE, op6_voronoi_knn, op9_cross_polytope
from oracle import same

SCHEMA = "vec_id long, embedding array<float>, V string"


def _brute(rows, k, divisor, scale=None):
    keep = []
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            keep.append((i, np.array([math.floor(scale * np.float64(np.float32(x))) if scale else np.float64(np.float32(x)) for x in v])))
    out = {}
    for i, v in keep:
        if i % divisor == 0:
            scores = sorted(((-float(v @ w), j) for j, w in keep if j != i))[:k]
            out[i] = [(j, -s) for s, j in scores]
    return out


def _lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in out.items()}


def _rows(n, d, seed):
    r = random.Random(seed)
    hot = [r.gauss(0, 1) for _ in range(d)]
    return [(i, hot if i % 3 == 0 else [r.gauss(0, 1) for _ in range(d)], "x") for i in range(n)]


def test_voronoi_matches_sql(spark, small):
    same(op6_voronoi_knn(spark, small), ORACLE["op6_voronoi_knn"], small)


@pytest.mark.parametrize("block,chunk", [(2048, 16_384), (7, 40)])
def test_voronoi_is_exact_with_copies_blocks_and_chunks(spark, block, chunk):
    rows = _rows(400, 6, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = _lists(voronoi_knn.top_k(df, "vec_id", "embedding", F.col("id") % 5 == 0, k=7, pivots=16, seeds=30, block=block, chunk=chunk, scale=64))
    assert got == _brute(rows, 7, 5, 64)


def test_bounds_spare_clustered_vectors(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(24, 16)) * 4
    x = centres[np.arange(6000) % 24] + r.normal(size=(6000, 16)) * 0.05
    x *= 8 / np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    condition = F.col("id") % 20 == 0
    table, asked = vectors.distinct_vectors(vectors.encoded(vectors.valid(df, "vec_id", "embedding"), condition), 5)
    data, sought = voronoi_knn.dealt(table, 5, 64, 512, 2048, 500)
    groups, parts = sought.select("g").distinct().count(), 6000 / 500
    # without bounds each group gets all data, and each query goes to all parts
    assert groups > 4 and data.count() < 0.25 * groups * 6000 and sought.count() < 0.5 * parts * asked.count()
    got = _lists(voronoi_knn.top_k(df, "vec_id", "embedding", condition, k=5, pivots=64, seeds=512, chunk=500))
    want = _brute(rows, 5, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, None, "a"), (2, [], "a"), (3, [1.0, None], "a"), (4, [nan, 1.0], "a"), (5, [inf, 1.0], "a"), (6, [0.5, 0.5], "a"),
            (7, [1.0, 0.0], "a"), (None, [1.0, 1.0], "a"), (8, [1.0, 0.0], "a"), (8, [1.0, 0.0], "a"), (9, [1.0, 2.0, 3.0], "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = _lists(voronoi_knn.top_k(df, "vec_id", "embedding", F.col("id") == 0, k=20))
    assert got == {0: [(7, 1.0), (8, 1.0), (6, 0.5)]}
    got = _lists(cross_polytope.search(df, "vec_id", "embedding", F.col("id") == 0, k=20))
    assert got == {0: [(7, 1.0), (8, 1.0), (6, 0.5)]}
    for search in (voronoi_knn.top_k, cross_polytope.search):
        assert search(df.where("false"), "vec_id", "embedding", F.col("id") == 0).count() == 0


def test_zero_vectors_are_no_candidates_of_the_approximate_search(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.0, 0.0], ""), (2, [0.1, 0.1], "")], SCHEMA)
    assert _lists(cross_polytope.search(df, "vec_id", "embedding", F.col("id") == 0)) == {0: [(2, pytest.approx(0.1))]}


def test_hadamard_keeps_norms():
    x = np.random.default_rng(1).normal(size=(5, 16))
    x = x.T
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=0), np.linalg.norm(x, axis=0))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)


@pytest.mark.parametrize(("number", "most"), [(1, 3), (2, 40), (3, 25)])
def test_probes_are_the_likeliest_buckets(number, most):
    x = np.random.default_rng(2).normal(size=(9, 12))
    u = cross_polytope.units(x)
    got = cross_polytope.probes(u, 1, number, cross_polytope.places(number, 32, most), most)
    like = np.zeros((9, 1))
    for h in range(number):
        y = cross_polytope.turned(u, 1, h)
        y = np.concatenate((y, -y)).T
        like = (like[:, :, None] + y[:, None, :]).reshape(9, -1)
    want = np.argsort(-like, axis=1)[:, :most]
    assert [set(r) for r in got.tolist()] == [set(r) for r in want.tolist()]
    assert (cross_polytope.buckets(u, 1, number) == want[:, 0]).all()  # a vector is filed in its likeliest bucket


def _recall(spark, tmp_path, rows, divisor=20):
    """Recall, and vectors scored a query as a share of all."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    pq.write_table(pa.table({"vec_id": ids, "embedding": list(x)}), f"{tmp_path}/v.parquet")
    df = spark.read.parquet(f"{tmp_path}/v.parquet")
    lists, asked = cross_polytope.found(df, "vec_id", "embedding", F.col("id") % divisor == 0, 20)
    share = lists.agg(F.sum("scored")).first()[0] / asked.count() / len(np.unique(x, axis=0))
    got = _lists(cross_polytope.ranked(lists.select("key", "id", "score"), asked, 20))
    hits = 0
    for i in np.flatnonzero(ids % divisor == 0):
        score = x @ x[i]
        score[i] = -np.inf
        want = set(ids[np.argpartition(-score, 20)[:20]].tolist())
        hits += len(want & {j for j, _ in got[int(ids[i])]})
    return hits / 20 / (ids % divisor == 0).sum(), share


def test_recall_on_the_tables(spark, tmp_path):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    recall, _ = _recall(spark, tmp_path, rows)
    assert recall >= 0.95


def test_few_vectors_are_scored_at_larger_sizes(spark, tmp_path):
    shares = []
    for n, divisor in ((50_000, 100), (150_000, 750)):
        x = np.random.default_rng(8).normal(size=(n, 64))  # the hardest case: no clusters
        (tmp_path / str(n)).mkdir()
        recall, share = _recall(spark, tmp_path / str(n), list(enumerate(x / np.linalg.norm(x, axis=1)[:, None])), divisor)
        assert recall >= 0.9
        shares.append(share)
    assert shares[1] < shares[0] < 0.1  # all products of a query and a vector are counted


def test_queries_that_find_too_few_meet_all(spark, monkeypatch):
    rows = _rows(300, 5, 4)
    monkeypatch.setattr(cross_polytope, "probed_share", lambda n: 0.004)
    got = _lists(cross_polytope.search(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("id") % 10 == 0, k=7))
    assert all(len(x) == 7 for x in got.values()) and len(got) == 30


def test_recall_and_exact_scores(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want, got = _brute(rows, 20, 20), _lists(op9_cross_polytope(spark, small))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    vec = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert all(s == pytest.approx(float(vec[q] @ vec[i]), abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_blocks_lose_nothing(spark, monkeypatch):
    df = spark.createDataFrame(_rows(300, 5, 2), SCHEMA)
    lists = []
    for block, asked in ((2048, 4096), (7, 5)):
        monkeypatch.setattr(cross_polytope, "BLOCK", block)
        monkeypatch.setattr(cross_polytope, "QUERY_BLOCK", asked)
        lists.append(_lists(cross_polytope.search(df, "vec_id", "embedding", F.col("id") % 10 == 0, k=5)))
    assert lists[0] == lists[1]
