"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: sources share the whole size by weight; a source stops at ``cap`` times its own
size and the excess is shared anew by weight, until none is above. That fixed point has a
closed form over the sources in order of capacity to weight.

Copies: a source's ratio target / size has a whole part, the copies that every document
certainly gets, and a remainder, the inclusion probability of one more. Who gets that one is
drawn by Pareto order sampling: documents are ranked by q = odds of a random number / odds
of their inclusion, and the first of them are taken as far as the source's remaining words
reach. So the sample's size is fixed (in words, to within half a document), and documents
may have unequal probabilities: by source always, and by ``propensity`` within a source.

The cut is found without sorting a source: v = q / (1 + q) in 48 bits, and 14 bits of a hash of
the whole row for rows of one v, are split into 512 buckets, words are summed by source and bucket, and the bucket where the target falls is
split again until it holds at most ``cut_rows`` rows. Only those rows are put in order.

Random numbers are hashes of identifying columns and a seed, hence reruns agree.

Defined results: a null source is a source of its own, last in order; null or negative sizes
count as 0; documents of size 0 never change a total, and get the certain copies and one
more if they rank before the cut; rows equal in all identifying columns rank by a hash of all
columns, maps by their sorted entries and variants as JSON; of rows equal in everything any may be
taken, and a cut that falls among those sorts them in one task; targets are one row a source, taken
together in one small task;
an empty table gives an empty result; further columns pass through, and those named like a
result column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, without

BITS, TIE_BITS, LEVEL_BITS, CUT_ROWS = 48, 14, 9, 100_000
#: The least propensity: a document of none ranks last, and is drawn if all others don't reach the target.
LEAST = 1e-9
MADE = ["source_size", "target", "copies", "taken"]


def targets(totals: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """``totals`` (source, source_size) with ``target``: one row a source, so one small task."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    by_room = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(
        (F.col("source_size") / F.col("w")).desc(), F.col("source").desc_nulls_first()
    ).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * cap
    level = (F.sum("source_size").over(everything).cast("double") - full) / F.sum("w").over(rest)
    return (
        totals.withColumn("w", weight)
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("source_size") * F.lit(cap), F.col("w") * F.col("level")))
        .drop("w", "level")
    )


def hashable(c: Column, kind: T.DataType) -> Column:
    """The column in types that have a hash: maps as entries in order, variants as JSON."""
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(hashable(e["key"], kind.keyType).alias("k"), hashable(e["value"], kind.valueType).alias("v")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: hashable(x, kind.elementType))
    if isinstance(kind, T.StructType) and kind.fields:
        return F.struct(*[hashable(c[f"`{f.name}`"] if "." in f.name else c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)])
    return c


def _rank(u: Column, share: Column, propensity: Column, tie: Column) -> Column:
    """v in [0, 2^BITS), the Pareto ratio made monotone in a bounded whole number, and TIE_BITS for rows of one v."""
    x = (u + F.lit(0.5)) / F.lit(float(1 << BITS))
    odds = x / (F.lit(1.0) - x)
    q = odds / (propensity * (share / (F.lit(1.0) - share)))
    v = F.floor(q / (F.lit(1.0) + q) * F.lit(float(1 << BITS))).cast("long")
    return F.least(v, F.lit((1 << BITS) - 1)) * F.lit(1 << TIE_BITS) + tie


def mix(
    docs: DataFrame,
    size: str,
    source: str = "source",
    identity: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: str = "mix-1",
    propensity: str | None = None,
    cut_rows: int = CUT_ROWS,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``copies`` (int) and ``taken`` (size times copies), one row a document."""
    base = without(docs, [n for n in MADE if n not in {size, source, propensity, *identity}])
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])
    kept = materialise(
        base.select(
            F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("__row"),  # no name of the caller's can clash below
            F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("__n"),
            F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long").alias("__u"),
            F.pmod(F.xxhash64(*[hashable(F.col(f"`{f.name}`"), f.dataType) for f in base.schema]), F.lit(1 << TIE_BITS)).alias("__t"),
            # a null source has a key of its own
            F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("__s"),
            (F.greatest(F.coalesce(F.col(propensity).cast("double"), F.lit(1.0)), F.lit(LEAST)) if propensity else F.lit(1.0)).alias("__p"),
        ),
        "mix-docs",
    )
    totals = kept.groupBy("__s").agg(F.sum("__n").alias("source_size"))
    named = totals.withColumn("source", F.when(F.col("__s") != "n", F.expr("substring(__s, 2)")))
    plan = targets(named, weights, cap).drop("source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio).cast("int")).withColumn(
        "left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    )
    plan = plan.withColumn("share", F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(0.0))
    state = materialise(
        plan.withColumns({"lo": F.lit(0).cast("long"), "bits": F.lit(BITS + TIE_BITS), "below": F.lit(0).cast("long")}).repartition(1),
        "mix-plan",
    )  # a row a source: one file

    drawn = (F.col("share") > 0) & (F.col("share") < 1)
    v = F.when(drawn, _rank(F.col("__u"), F.col("share"), F.col("__p"), F.col("__t")))
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("lo") + F.expr("shiftleft(1L, bits)"))

    def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return rows.join(plan, "__s").withColumn("v", v)

    while True:
        narrow = kept.select("__s", "__u", "__n", "__p", "__t")
        step = F.expr(f"greatest(bits - {LEVEL_BITS}, 0)").cast("int")
        sums = (
            ranked(narrow, state)
            .where(inside)
            .groupBy("__s", F.expr(f"shiftright(v - lo, greatest(bits - {LEVEL_BITS}, 0))").alias("digit"))
            .agg(F.sum("__n").alias("words"), F.count(F.lit(1)).alias("n"))
        )
        w = Window.partitionBy("__s").orderBy("digit")
        cut = (
            sums.withColumn("upto", F.sum("words").over(w))
            .join(state, "__s")
            .where(F.col("below") + F.col("upto") >= F.col("left"))
            .groupBy("__s")
            .agg(F.min(F.struct("digit", "upto", "words", "n")).alias("c"))
        )
        # a source whose documents do not reach what is left keeps its whole range
        refined = (
            state.join(cut, "__s", "left")
            .withColumn("step", step)
            .select(
                *[c for c in state.columns if c not in ("lo", "bits", "below")],
                F.when(F.col("c").isNull(), F.col("lo")).otherwise(F.col("lo") + F.expr("shiftleft(c.digit, step)")).alias("lo"),
                F.when(F.col("c").isNull(), F.col("bits")).otherwise(F.col("step")).alias("bits"),
                (F.col("below") + F.coalesce(F.col("c.upto") - F.col("c.words"), F.lit(0))).alias("below"),
                F.coalesce(F.col("c.n"), F.lit(0)).alias("n"),
            )
        )
        new = materialise(refined.repartition(1), "mix-plan")
        discard(state)
        most = new.where("bits > 0").agg(F.max("n")).first()[0] or 0
        state = new.drop("n")
        state._millrace_path = new._millrace_path
        if most <= cut_rows:
            break

    rows = ranked(kept, state)
    edge = rows.where(drawn & inside)
    # rows that differ anywhere are in the same order in each run
    order = Window.partitionBy("__s").orderBy("v", *[F.col("__row")[c].asc_nulls_first() for c in identity], "__n")
    upto = F.col("below") + F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # taken if that brings the total nearer to what is left
    edge = edge.withColumn("more", (upto * 2 - F.col("__n") <= F.col("left") * 2).cast("int"))
    rest = rows.where(~F.coalesce(drawn & inside, F.lit(False))).withColumn(
        "more", F.coalesce(drawn & (F.col("v") < F.col("lo")), F.lit(False)).cast("int")
    )
    edge = edge.coalesce(docs.sparkSession.sparkContext.defaultParallelism)  # at most cut_rows a source
    out = rest.unionByName(edge).withColumn("__copies", F.col("whole") + F.col("more"))
    return out.select(
        "__row.*", "source_size", "target", F.col("__copies").alias("copies"), (F.col("__n") * F.col("__copies")).alias("taken")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """Each document as often as it has copies; ``copies`` itself and what else :func:`mix` added is dropped."""
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))
    rows = mixed.withColumn("__copy", F.explode(times))
    return reduce(lambda d, c: d.drop(c), [*MADE, "__copy"], rows)
