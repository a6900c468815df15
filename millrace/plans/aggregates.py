"""Queries over aggregate functions: moments by value, percentiles, lists, and sketches held to an error bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import functions as MF
from millrace.sources.tables import table

from .registry import query, sql

sql(
    "spread",
    """SELECT l_returnflag, CAST(stddev_samp(l_quantity) AS DECIMAL(20,9)) AS sds, CAST(stddev_pop(l_quantity) AS DECIMAL(20,9)) AS sdp,
      CAST(var_samp(l_quantity) AS DECIMAL(20,9)) AS vs, CAST(var_pop(l_quantity) AS DECIMAL(20,9)) AS vp, CAST(corr(l_quantity, l_extendedprice) AS DECIMAL(20,9)) AS c,
      CAST(covar_samp(l_quantity, l_linenumber) AS DECIMAL(20,9)) AS cs, CAST(covar_pop(l_quantity, l_linenumber) AS DECIMAL(20,9)) AS cp
    FROM {lineitem} GROUP BY l_returnflag""",
)
sql(
    "regressions",
    """SELECT l_returnflag, CAST(regr_slope(l_extendedprice, l_quantity) AS DECIMAL(20,6)) AS slope, CAST(regr_intercept(l_extendedprice, l_quantity) AS DECIMAL(20,6)) AS icpt,
      CAST(regr_r2(l_extendedprice, l_quantity) AS DECIMAL(20,9)) AS r2, CAST(regr_avgx(l_extendedprice, l_quantity) AS DECIMAL(20,9)) AS ax, CAST(regr_count(l_tax, l_discount) AS BIGINT) AS n,
      CAST(regr_sxx(l_linenumber, l_quantity) AS DECIMAL(20,4)) AS sxx
    FROM {lineitem} GROUP BY l_returnflag""",
)


@query("SELECT l_returnflag, CAST(skewness(l_quantity) AS DECIMAL(20,8)) AS skew, CAST(kurtosis(l_quantity) AS DECIMAL(20,8)) AS kurt FROM lineitem GROUP BY 1")
def skewness_and_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of a sample: Spark's own are of the population."""
    x = F.col("l_quantity")
    made = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(MF.sample_skewness(x).alias("skew"), MF.sample_kurtosis(x).alias("kurt"))
    return made.select("l_returnflag", *[F.col(c).cast("decimal(20,8)").alias(c) for c in ("skew", "kurt")])


sql(
    "percentiles_within",
    """SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity DESC) AS low,
      percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS d1, median(l_quantity) AS med, mode() WITHIN GROUP (ORDER BY l_linestatus) AS most
    FROM {lineitem} GROUP BY l_returnflag""",
    """SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity DESC) AS low,
      quantile_disc(l_quantity, 0.25) AS d1, median(l_quantity) AS med, mode(l_linestatus) AS most FROM lineitem GROUP BY 1""",
)
sql(
    "lists_and_any",
    """SELECT c_mktsegment, any_value(c_mktsegment) AS any,
      first_value(c_mktsegment) AS f, last(c_mktsegment) AS l, array_join(array_sort(array_agg(DISTINCT c_nationkey % 3)), ',') AS thirds,
      try_sum(c_custkey) AS ts, CAST(try_avg(c_custkey) AS DECIMAL(20,6)) AS ta,
      every(c_custkey >= 0) AS ev, some(c_custkey = 1) AS sm
    FROM {customer} GROUP BY c_mktsegment""",
    """SELECT c_mktsegment, c_mktsegment AS any,
      c_mktsegment AS f, c_mktsegment AS l, array_to_string(list_sort(list(DISTINCT c_nationkey % 3)), ',') AS thirds,
      CAST(sum(c_custkey) AS BIGINT) AS ts, CAST(avg(c_custkey) AS DECIMAL(20,6)) AS ta, bool_and(c_custkey >= 0) AS ev, bool_or(c_custkey = 1) AS sm
    FROM customer GROUP BY 1""",
)
sql(
    "joined_strings",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey DESC) AS names, string_agg(CAST(n_nationkey AS STRING)) AS some FROM {nation} WHERE n_nationkey < 5 GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names, string_agg(CAST(n_nationkey AS VARCHAR), '') AS some FROM nation WHERE n_nationkey < 5 GROUP BY 1",
)


@query("SELECT r_name, product(n_nationkey + 1) AS p FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.product(F.col("n_nationkey") + 1).alias("p"))


sql(
    "grouping_ids",
    """SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g, count(*) AS n
    FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)


def _near(estimate, exact, share: float):
    return F.abs(estimate - exact) <= exact * F.lit(share)


@query("SELECT count(DISTINCT o_custkey) AS exact, true AS hyperloglog, true AS hll, true AS hll_union, true AS theta, true AS bitmap FROM orders")
def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of a distinct count, held to four standard errors of each sketch (bitmaps are exact)."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    one = rows.agg(
        F.count_distinct("o_custkey").alias("exact"),
        F.approx_count_distinct("o_custkey", 0.02).alias("a"),
        F.hll_sketch_estimate(F.hll_sketch_agg("o_custkey", F.lit(12))).alias("b"),
        F.theta_sketch_estimate(F.theta_sketch_agg("o_custkey")).alias("c"),
    )
    # a sketch a group, then their union: how estimates are rolled up
    parts = rows.groupBy("o_orderstatus").agg(F.hll_sketch_agg("o_custkey", F.lit(12)).alias("s"))
    union = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("d"))
    bits = rows.groupBy(F.bitmap_bucket_number("o_custkey").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("o_custkey")).alias("bits"))
    bits = bits.agg(F.sum(F.bitmap_count("bits")).alias("e"))
    return one.crossJoin(union).crossJoin(bits).select(  # three tables of one row
        "exact",
        _near(F.col("a"), F.col("exact"), 0.08).alias("hyperloglog"),
        _near(F.col("b"), F.col("exact"), 0.08).alias("hll"),
        _near(F.col("d"), F.col("exact"), 0.08).alias("hll_union"),
        _near(F.col("c"), F.col("exact"), 0.08).alias("theta"),
        (F.col("e") == F.col("exact")).alias("bitmap"),
    )


@query("SELECT l_returnflag, count(*) AS n, true AS percentile, true AS kll, true AS histogram, true AS count_min FROM lineitem GROUP BY 1")
def quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate medians lie between the exact 48th and 52nd percentile; histograms and count-min sketches hold all rows."""
    made = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile("l_extendedprice", F.array(F.lit(0.48), F.lit(0.52))).alias("exact"),
            F.approx_percentile("l_extendedprice", 0.5, 10_000).alias("a"),
            F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("l_extendedprice", F.lit(400)), F.lit(0.5)).alias("b"),
            F.expr("histogram_numeric(l_extendedprice, 20)").alias("h"),
            F.expr("count_min_sketch(l_linenumber, 0.01d, 0.95d, 7)").alias("c"),
        )
    )

    def between(x: str):
        return (F.col(x) >= F.col("exact")[0]) & (F.col(x) <= F.col("exact")[1])

    return made.select(
        "l_returnflag",
        "n",
        between("a").alias("percentile"),
        between("b").alias("kll"),
        (F.aggregate("h", F.lit(0.0), lambda s, x: s + x["y"].cast("double")) == F.col("n")).alias("histogram"),
        (F.octet_length("c") > 100).alias("count_min"),
    )
