from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.inequality import ie_join, matches
from millrace.operators.quantiles import exact_percentiles
from millrace.operators.sketches import CountMin, heavy_hitters
from millrace.plans import catalog

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def test_matches_are_those_of_a_nested_loop():
    rnd = np.random.default_rng(1)
    for n, m in ((0, 3), (3, 0), (1, 1), (60, 45)):
        x1, x2, y1, y2 = (rnd.integers(0, 12, k) for k in (n, n, m, m))
        for s in ((True, True), (True, False), (False, True), (False, False)):
            got = set(zip(*(a.tolist() for a in matches(x1, x2, y1, y2, s)), strict=True))
            a, b = (OPS["<" if z else "<="] for z in s)
            assert got == {(i, j) for i in range(n) for j in range(m) if a(x1[i], y1[j]) and b(x2[i], y2[j])}


@pytest.mark.parametrize(("one", "two"), [("<", ">"), (">=", "<="), (">", ">=")])
def test_inequality_join_matches_a_nested_loop(spark, one, two):
    rnd = random.Random(7)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0]
    left = spark.createDataFrame([(i, rnd.choice([*odd, *[rnd.randrange(50) / 2 for _ in range(20)]]), rnd.randrange(-9, 9)) for i in range(150)], "i int, a double, b long")
    right = spark.createDataFrame([(i, rnd.choice([*odd, *[rnd.randrange(50) / 2 for _ in range(20)]]), rnd.choice([None, rnd.randrange(-9, 9)])) for i in range(90)], "j int, c double, d long")
    got = ie_join(left, right, ("a", one, "c"), ("b", two, "d"), block_rows=16)
    fine = [x.where(~F.isnan(c)) for x, c in ((left, "a"), (right, "c"))]
    want = fine[0].join(fine[1], F.expr(f"a {one} c AND b {two} d"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ie_join(left, right.limit(0), ("a", one, "c"), ("b", two, "d")).count() == 0


def test_no_nested_loop_and_few_blocks(spark, small):
    plan = catalog.QUERIES["overlapping_sessions"](spark, small)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    n = 4000
    rows = spark.range(n).select(F.col("id").alias("lo"), (F.col("id") + 3).alias("hi"))
    other = rows.select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    out = ie_join(rows, other, ("lo", "<", "hi2"), ("hi", ">", "lo2"), block_rows=100)
    assert out.count() == n * 5 - 2 * (2 + 1)
    met = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(met) == n * 5 - 6


@pytest.mark.parametrize(("bins", "last"), [(4, 3), (16, 10), (64, 10_000)])
def test_percentiles_are_exact(spark, bins, last):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 50 > 0, (F.col("id") % 7).cast("string")).alias("g"),
        F.when(F.col("id") % 10 > 0, F.exp((F.col("id") * 37 % 101).cast("double"))).when(F.col("id") % 20 > 0, 1.0).alias("v"),
    )
    rows = rows.unionByName(spark.createDataFrame([("one", 5.0), ("none", None)], rows.schema))
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    for keys in (["g"], []):
        got = exact_percentiles(rows, "v", shares, keys, bins, last)
        want = rows.where("v IS NOT NULL").groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p"))
        want = want.select(*keys, F.posexplode("p").alias("at", "percentile"))
        assert sorted(((*r[:-2], r.share, r.percentile) for r in got.collect()), key=repr) == sorted(((*r[:-2], shares[r.at], r.percentile) for r in want.collect()), key=repr)
    assert exact_percentiles(rows.limit(0), "v", shares).count() == 0


def test_sketches_read_back_what_was_counted(spark):
    rows = spark.range(5000).select((F.col("id") % 997 * F.lit(10**12) - 5).alias("k"))
    raw = rows.agg(F.expr("count_min_sketch(k, 0.0005d, 0.999d, 3)")).first()[0]
    sketch = CountMin(bytes(raw))
    keys = np.array([i % 997 * 10**12 - 5 for i in range(997)])
    exact = np.array([5000 // 997 + (i < 5000 % 997) for i in range(997)])
    got = sketch.estimates(keys)
    assert sketch.total == 5000 and (got >= exact).all() and (got <= exact + 3).all() and CountMin(sketch.raw()).raw() == bytes(raw)
    both = CountMin(bytes(raw)).merged(CountMin(bytes(raw)))
    assert both.total == 10_000 and (both.estimates(keys) == 2 * got).all()
    other = CountMin(bytes(rows.agg(F.expr("count_min_sketch(k, 0.0005d, 0.999d, 4)")).first()[0]))
    with pytest.raises(ValueError):
        both.merged(other)


def test_heavy_hitters_are_exact(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 1, "warm").when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"))
    for share in (0.2, 0.005, 0.0001):
        got = {r.k: r.n for r in heavy_hitters(rows.repartition(5), "k", share).collect()}
        want = {r.k: r["count"] for r in rows.where("k IS NOT NULL").groupBy("k").count().where(F.col("count") > share * 20_000).collect()}
        assert got == want and "hot" in got
    assert heavy_hitters(rows.limit(0), "k", 0.1).count() == 0
