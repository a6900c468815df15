"""Exact percentiles of groups of any size, by refined histograms.

Spark's ``percentile`` keeps all values of a group in one buffer. Here each wanted rank is narrowed down: a round
takes quantile sketches of the values still in question as edges of a histogram, counts exactly what lies
between the edges, and goes on with the bin that holds the rank. Equal values are never
parted, so a bin of one value ends it; a bin of few rows is put in order. A round divides the rows in question
by about the number of bins; what a task or the driver holds is bins and sketches, not values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import written

BINS, ACCURACY, LAST_ROWS = 64, 2000, 10_000


def exact_percentiles(df: DataFrame, value: str, shares: list[float], group: list[str] | None = None, bins: int = BINS, last_rows: int = LAST_ROWS) -> DataFrame:
    """(``group``.., share, percentile): by linear interpolation between ranks, as ``percentile`` has it.

    Nulls don't count, as in ``percentile``, nor do NaN; a group without values has no row. Null group keys are a group.
    """
    group = group or []
    keys = [f"__g{i}" for i in range(len(group))]
    v = F.col(f"`{value}`").cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.struct(*[F.col(f"`{c}`").alias(k) for c, k in zip(group, keys, strict=True)], F.lit(0).alias("o")).alias("__g"), v.alias("__v"))

    # wanted ranks: for each share the one below its place and the one above
    sizes = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    place = F.col("share") * (F.col("n") - 1)
    wanted = written(sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in sorted(set(shares))]))).withColumn("place", place), "quantile-places")
    ranks = F.array_distinct(F.array(F.floor("place"), F.ceil("place")))
    # rank: how many values lie before it; all values of lo .. hi are in question, ``below`` lie before lo
    goals = written(
        wanted.select("__g", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).distinct(), "quantile-goals"
    )
    probes = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    while (goals.where((F.col("lo") < F.col("hi")) & (F.col("inside") > last_rows))).limit(1).count():
        open_ = goals.where((F.col("lo") < F.col("hi")) & (F.col("inside") > last_rows))
        spans = open_.select("__g", "lo", "hi").distinct()  # ranks of one span are looked for together
        inside = rows.join(spans, "__g").where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        edges = written(inside.groupBy("__g", "lo", "hi").agg(F.array_distinct(F.percentile_approx("__v", probes, ACCURACY)).alias("edges")), "quantile-edges")
        dealt = rows.join(edges, "__g").where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        # a bin: the values above the edge before it, up to its own; an edge itself is a bin of its own
        bin_ = F.size(F.filter("edges", lambda e: e < F.col("__v"))) * 2 + F.array_contains("edges", F.col("__v")).cast("int")
        counted = dealt.groupBy("__g", "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        before = F.sum("k").over(Window.partitionBy("__g", "lo", "hi").orderBy("bin")) - F.col("k")
        held = counted.withColumn("before", before)
        found = open_.select("__g", "lo", "hi", "rank", "below").join(held, ["__g", "lo", "hi"])
        found = found.where((F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("k")))
        found = found.select("__g", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("k").alias("inside"))
        closed = goals.where((F.col("lo") >= F.col("hi")) | (F.col("inside") <= last_rows))
        goals = written(closed.unionByName(found), "quantile-goals")

    single = goals.where(F.col("lo") >= F.col("hi")).select("__g", "rank", F.col("lo").alias("x"))
    few = goals.where(F.col("lo") < F.col("hi"))
    spans = few.select("__g", "lo", "hi", "below").distinct()
    near = rows.join(spans, "__g").where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
    near = near.withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy("__g", "lo", "hi").orderBy("__v")) - 1)
    placed = few.select("__g", "rank", "lo", "hi").join(near.select("__g", "rank", "lo", "hi", F.col("__v").alias("x")), ["__g", "rank", "lo", "hi"])
    values = single.unionByName(placed.select("__g", "rank", "x"))

    each = wanted.select("__g", "share", "place")
    low = each.withColumn("rank", F.floor("place")).join(values.withColumnRenamed("x", "a"), ["__g", "rank"]).drop("rank")
    both = low.withColumn("rank", F.ceil("place")).join(values.withColumnRenamed("x", "b"), ["__g", "rank"])
    high, part = F.ceil("place"), F.floor("place")
    made = F.when(high == part, F.col("a")).otherwise((high - F.col("place")) * F.col("a") + (F.col("place") - part) * F.col("b"))
    return both.select(*[F.col(f"__g.{k}").alias(c) for k, c in zip(keys, group, strict=True)], "share", made.alias("percentile"))
