from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.llm import pareto_mix
from millrace.llm.queries import ORACLE, op5_pareto_mix
from oracle import same


def _water(sizes: dict, weights: dict, cap: float) -> dict:
    """Targets by sharing the excess again and again."""
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        out = {s: cap * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def test_matches_sql(spark, small):
    same(op5_pareto_mix(spark, small), ORACLE["op5_pareto_mix"], small)


@pytest.mark.parametrize("cut_rows", [10, 100_000])
def test_targets_totals_and_caps(spark, cut_rows):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("n"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 200 == 1, "tiny").when(F.col("id") % 7 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        F.lit("x").alias("left"), F.lit("y").alias("bits"),
    )
    out = pareto_mix.mix(df, "n", cut_rows=cut_rows).collect()
    assert len(out) == 20_000 and {r.left for r in out} == {"x"}
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.n
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken == r.n * r.copies and 0 <= r.copies <= 3
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = _water(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, 3.0)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 97 / 2


def test_the_cut_does_not_depend_on_its_rounds(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 50).alias("n"), F.lit("a").alias("source"), (F.col("id") % 3).alias("p"))
    df = df.withColumn("source", F.when(F.col("doc_id") % 4 == 0, "b").otherwise("a"))
    runs = [sorted((r.doc_id, r.copies) for r in pareto_mix.mix(df, "n", propensity="p", cut_rows=c).collect()) for c in (5, 10**6)]
    assert runs[0] == runs[1]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 5, None), (None, 5, None), (1, None, "a"), (2, 0, "a"), (3, 7, "b"), (3, 7, "b")], "doc_id long, n int, source string")
    out = pareto_mix.mix(df, "n").collect()
    assert len(out) == 6 and all(r.taken >= 0 for r in out)
    assert pareto_mix.repeated(pareto_mix.mix(df, "n")).columns == df.columns
    assert pareto_mix.mix(df.where("false"), "n").count() == 0


def test_rows_of_one_id_rank_alike_in_each_run(spark):
    rows = [(1, "s", n) for n in range(1, 60)] + [(2, "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    runs = [sorted(map(tuple, pareto_mix.mix(d, "size").select("doc_id", "size", "taken").collect())) for d in (docs, docs.repartition(7, "size"))]
    assert runs[0] == runs[1] and any(t for *_, t in runs[0])


def test_maps_and_variants_and_a_hot_null_id(spark):
    df = spark.range(4000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).alias("n"), F.create_map(F.lit("k"), F.col("id")).alias("m"),
        F.array(F.create_map(F.lit(1), F.lit("x"))).alias("ms"), F.parse_json(F.concat(F.lit('{"a": '), F.col("id"), F.lit("}"))).alias("v"),
    ).unionByName(spark.createDataFrame([(1, "t", 4)], "doc_id long, source string, n int"), allowMissingColumns=True)
    runs = []
    for rows in (df, df.repartition(5, "n")):
        out = pareto_mix.mix(rows, "n", cut_rows=20)
        assert out.count() == 4001
        runs.append(sorted((r.m["k"] if r.m else -1, r.copies) for r in out.collect()))
    assert runs[0] == runs[1] and len({c for _, c in runs[0]}) > 1
