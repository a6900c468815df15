from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from millrace.functions import dot, round_half_up, sample_skewness
from millrace.operators.asof import asof_join
from millrace.operators.ranges import range_join
from millrace.operators.recursion import reachable
from millrace.operators.sampling import bottom_k
from millrace.operators.skew import salted_join
from millrace.operators.windows import groups_frame, sessions, top_per_group


def test_asof_nulls_ties_and_strictness(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, None, 5), (4, "a", None), (5, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("b", None, 1), (None, 1, 7)], "k string, t int, v int")
    got = {r.id: r.v for r in asof_join(left, right, "k", "t", "t", {"v": "v"}).collect()}
    assert got == {1: 51, 2: None, 3: None, 4: None, 5: None}
    got = {r.id: r.v for r in asof_join(left, right, "k", "t", "t", {"v": "v"}, strict=True).collect()}
    assert got[1] == 20


def test_range_join_matches_a_nested_loop(spark):
    points = spark.range(200).select(((F.col("id") * 37) % 101 / 3.0).alias("p"))
    spans = spark.range(40).select((F.col("id") * 0.9 - 2).alias("lo"), (F.col("id") * 0.9 + F.col("id") % 5 - 2).alias("hi"))
    got = range_join(points, spans, F.col("p"), F.col("lo"), F.col("hi"), 1.5)
    want = points.join(spans, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi")))
    assert sorted(map(tuple, got.select("p", "lo", "hi").collect())) == sorted(map(tuple, want.collect()))


def test_range_join_takes_wide_endless_and_odd_spans(spark):
    inf, nan = float("inf"), float("nan")
    points = spark.createDataFrame([(x,) for x in (0.5, 3.0, 1e12, -7.25, inf, nan, None)], "p double")
    bounds = [(0.0, 1e15), (-1e9, 4.0), (-inf, 0.5), (0.0, inf), (3.0, 3.0), (5.0, 1.0), (nan, 2.0), (0.0, nan), (None, 1.0), (2.9999, 3.0001), (-inf, inf)]
    spans = spark.createDataFrame(bounds, "lo double, hi double")
    got = range_join(points, spans, F.col("p"), F.col("lo"), F.col("hi"), 1.0).collect()
    want = [(p, lo, hi) for p in (0.5, 3.0, 1e12, -7.25) for lo, hi in bounds if lo is not None and lo == lo and hi == hi and lo <= p < hi]
    assert sorted(map(tuple, got)) == sorted(want)
    assert range_join(points, spans.where("false"), F.col("p"), F.col("lo"), F.col("hi"), 1.0).count() == 0


def test_asof_by_blocks_is_the_same(spark):
    left = spark.range(300).select((F.col("id") % 3).cast("string").alias("k"), ((F.col("id") * 37) % 211).alias("t"), "id", F.lit(1).alias("v"))
    right = spark.range(60).select((F.col("id") % 3).cast("string").alias("k"), ((F.col("id") * 53) % 199).alias("t"), F.col("id").alias("r"))
    odd = spark.createDataFrame([(None, 3, 1000, 0), ("1", None, 1001, 0)], left.schema)
    for strict in (False, True):
        plain, cut = (asof_join(left.unionByName(odd), right, "k", "t", "t", {"V": "r"}, strict, b) for b in (None, lambda t: F.floor(t / 10)))
        assert plain.columns == cut.columns == ["k", "t", "id", "V"]
        assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, cut.collect()), key=repr)
        assert plain.where("V IS NOT NULL").count() > 200


def test_salted_join_keeps_unmatched_rows(spark):
    large = spark.createDataFrame([(k, i) for i in range(50) for k in (1, 1, 2)], "k int, i int")
    small = spark.createDataFrame([(1, "x")], "k int, v string")
    out = salted_join(large, small, "k", 4, "left")
    assert out.count() == 150 and out.where("v IS NULL").count() == 50


def test_windows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 4), ("b", 1)], "g string, o int")
    got = sorted((r.g, r.o, r.n) for r in groups_frame(rows, ["g"], "o", 1, 0, {"n": F.count(F.lit(1))}).collect())
    assert got == [("a", 1, 2), ("a", 1, 2), ("a", 2, 3), ("a", 4, 2), ("b", 1, 1)]
    assert top_per_group(rows, ["g"], [F.desc("o")], 1).count() == 2
    t = dt.datetime(2024, 1, 1)
    times = spark.createDataFrame([("u", t), ("u", t + dt.timedelta(minutes=5)), ("u", t + dt.timedelta(hours=2))], "k string, t timestamp")
    assert [r.session for r in sessions(times, "k", "t", "30 MINUTES").orderBy("t").collect()] == [0, 0, 1]


def test_functions(spark):
    df = spark.createDataFrame([(1.005, [1.0, 2.0], [3.0, 4.0])], "x double, a array<double>, b array<double>")
    r = df.select(round_half_up(F.col("x"), 2).alias("r"), dot(F.col("a"), F.col("b")).alias("d")).first()
    assert (r.r, r.d) == (1.01, 11.0)
    assert spark.range(2).agg(sample_skewness(F.col("id")).alias("s")).first().s is None


def test_asof_leaves_null_keys_where_they_are(spark):
    left = spark.range(0, 2000, 1, 8).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("k"), F.col("id").alias("t"))
    right = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = asof_join(left, right, "k", "t", "t", {"v": "v"})
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 2000 * 2 / 8
    assert got.where("k IS NULL AND v IS NOT NULL").count() == 0 and got.where("v IS NOT NULL").count() > 190


def test_reachable_ends_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (8, 9), (None, 1), (1, None)], "src int, dst int")
    roots = spark.createDataFrame([(1,), (1,), (None,)], "node int")
    assert sorted(map(tuple, reachable(edges, roots).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert sorted(map(tuple, reachable(edges, roots, 1).collect())) == [(1, 0), (2, 1)]
    chain = spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert reachable(chain, spark.range(1).toDF("node")).agg(F.max("hops")).first()[0] == 20


def test_samples_have_their_size_and_estimate_sums(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 50).alias("w"))
    made = [bottom_k(x, 300, ["id"], ["g"], "w").collect() for x in (rows, rows.repartition(7))]
    assert sorted(made[0]) == sorted(made[1]) and len(made[0]) == 600
    for g in (0, 1):
        total = rows.where(F.col("g") == g).agg(F.sum("w")).first()[0]
        assert abs(sum(r.estimate for r in made[0] if r.g == g) - total) < 0.1 * total
    few = bottom_k(rows, 10_000, ["id"], weight="w").collect()
    assert len(few) == 4900 and all(r.estimate == r.w for r in few)
