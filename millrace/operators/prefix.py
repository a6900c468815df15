"""Window functions over a hot or missing partition key, as a two-pass prefix scan.

Spark sorts each window partition in one task, and without PARTITION BY the whole table. Here
rows are dealt by ranges of (partition key, order), so that a key's history is cut into runs,
one a task. The first pass sums each run up; the sums of earlier runs are what a run starts
from. The second pass puts that start into the run as a row before its first one, where an
ordinary window over (run, key) picks it up. Two exchanges and one table in the shared folder; no
task has more than its range, whatever the keys are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import written

_BEFORE = Window.unboundedPreceding


def _by(name: str, prefix: str = "", flip: bool = False) -> Column:
    down, name = name.startswith("-"), name.removeprefix("-")
    c = F.col(f"{prefix}`{name}`")
    return c.desc_nulls_last() if down != flip else c.asc_nulls_first()


def prefix_scan(
    df: DataFrame,
    order: list[str],
    partition: list[str] | None = None,
    number: str | None = None,
    total: str | None = None,
    sums: dict[str, Column] | None = None,
    lags: dict[str, tuple[Column, int]] | None = None,
    tiles: dict[str, int] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``df`` with window columns over PARTITION BY ``partition`` ORDER BY ``order`` (a leading "-": descending).

    ``number``: the row number; ``total``: rows of the partition; ``sums``: running sums up to the row;
    ``lags``: a value so many rows before, null where there is none; ``tiles``: ntile of so many. Nulls come first
    in ascending and last in descending order. ``order`` should be total: rows equal in all of it are
    in any order, and in one task. ``parts``: ranges, by default the session's shuffle partitions.
    Columns named like a new one are replaced.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums, lags, tiles = sums or {}, lags or {}, tiles or {}
    keys = [f"__p{i}" for i in range(len(partition or []))]
    sum_at = {f"__s{i}": c for i, c in enumerate(sums.values())}
    lag_at = {f"__l{i}": c for i, (c, _) in enumerate(lags.values())}
    base = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
        *[F.col(f"`{c}`").alias(k) for c, k in zip(partition or [], keys, strict=True)],
        *[c.alias(k) for k, c in (sum_at | lag_at).items()],
    )
    along = [F.col(k).asc_nulls_first() for k in keys] + [_by(c, "__row.") for c in order]
    cut = base.repartitionByRange(parts, *along).withColumn("__run", F.spark_partition_id())
    runs = written(cut, "prefix-runs")

    # what each run holds, then what lies before it
    held = runs.groupBy("__run", *keys).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(k).alias(k) for k in sum_at])
    before = Window.partitionBy(*keys).orderBy("__run").rowsBetween(_BEFORE, -1)
    starts = held.select(
        "__run", *keys,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
        *[F.sum(k).over(before).cast(runs.agg(F.sum(k)).schema[0].dataType).alias(k) for k in sum_at],
    )
    if lags:
        most = max(k for _, k in lags.values())
        back = Window.partitionBy("__run", *keys).orderBy(*[_by(c, "__row.", flip=True) for c in order])
        last = runs.select("__run", *keys, F.row_number().over(back).alias("__r"), *lag_at).where(F.col("__r") <= most)
        ends = last.groupBy("__run", *keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("__r")).alias("r"), *lag_at))).alias("__tail"))
        near = Window.partitionBy(*keys).orderBy("__run").rowsBetween(-most, -1)
        tails = ends.select("__run", *keys, F.flatten(F.collect_list("__tail").over(near)).alias("__tail"))
        same = [F.col("a.__run") == F.col("b.__run"), *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]]
        starts = starts.alias("a").join(tails.alias("b"), same, "left").select("a.*", "b.__tail")
    if not keys:  # a row a range: as a small table of the driver's it needs no window of one task in the result's plan
        starts = spark.createDataFrame(starts.collect(), starts.schema)

    # the start of a run is its row 0
    rows = runs.withColumns({"__n": F.lit(1).cast("long"), "__at": F.lit(1)})
    typed = runs.select(*[F.sum(k).alias(k) for k in sum_at]).schema if sums else []
    rows = rows.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in typed})
    both = rows.unionByName(starts.withColumn("__at", F.lit(0)), allowMissingColumns=True).repartitionById(parts, F.col("__run"))
    w = Window.partitionBy("__run", *keys).orderBy("__at", *[_by(c, "__row.") for c in order])
    upto, run = w.rowsBetween(_BEFORE, 0), Window.partitionBy("__run", *keys).orderBy("__at").rowsBetween(_BEFORE, Window.unboundedFollowing)
    made: dict[str, Column] = {"__rn": F.sum("__n").over(upto)}
    if total or tiles:
        made["__all"] = F.first("__total", ignorenulls=True).over(run)
    made |= {f"__sum{i}": F.sum(k).over(upto) for i, k in enumerate(sum_at)}
    if lags:
        made["__i"] = F.row_number().over(w) - 1
        made["__tail"] = F.first("__tail", ignorenulls=True).over(upto)
        made |= {f"__lag{i}": F.lag(k, n).over(w) for i, (k, (_, n)) in enumerate(zip(lag_at, lags.values(), strict=True))}
    out = both.withColumns(made).where(F.col("__at") == 1)

    new: dict[str, Column] = {}
    if number:
        new[number] = F.col("__rn")
    if total:
        new[total] = F.col("__all")
    new |= {name: F.col(f"__sum{i}").cast(f.dataType) for i, (name, f) in enumerate(zip(sums, typed, strict=True))}
    for i, (name, (_, n)) in enumerate(lags.items()):
        far = F.lit(n) - F.col("__i") + 1  # from the end of what lies before the run
        new[name] = F.when(F.col("__i") > n, F.col(f"__lag{i}")).when(far <= F.size("__tail"), F.element_at("__tail", -far)[f"__l{i}"])
    for name, n in tiles.items():
        small, rest, at = F.floor(F.col("__all") / n), F.col("__all") % n, F.col("__rn") - 1
        wide = rest * (small + 1)
        new[name] = F.when(at < wide, F.floor(at / (small + 1)) + 1).otherwise(rest + F.floor((at - wide) / F.greatest(small, F.lit(1))) + 1).cast("int")
    gone = {x.lower() for x in new}
    return out.select(*[F.col(f"__row.`{c}`") for c in df.columns if c.lower() not in gone], *[c.alias(x) for x, c in new.items()])
