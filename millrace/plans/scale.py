"""Queries whose usual plans end in one task, a nested loop or an unbounded buffer, by operators that don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.inequality import ie_join
from millrace.operators.prefix import prefix_scan
from millrace.operators.quantiles import exact_percentiles
from millrace.operators.sketches import count_min_estimate, count_min_merge, heavy_hitters
from millrace.operators.windows import sessions
from millrace.sources.tables import table

from .registry import query

_LINE = ["l_shipdate", "-l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
_LINE_SQL = "l_shipdate, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax"


@query(f"""
    SELECT l_orderkey, l_partkey, l_shipdate, row_number() OVER w AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) OVER w AS DOUBLE) AS shipped,
      lag(l_orderkey, 3) OVER w AS earlier, CAST(ntile(100) OVER w AS INT) AS percent
    FROM lineitem WINDOW w AS (ORDER BY {_LINE_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def windows_over_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over all lines without PARTITION BY."""
    made = prefix_scan(
        table(spark, sf_dir, "lineitem"), _LINE, number="n", sums={"shipped": F.col("l_quantity").cast("decimal(12,2)")},
        lags={"earlier": (F.col("l_orderkey"), 3)}, tiles={"percent": 100},
    )
    return made.select("l_orderkey", "l_partkey", "l_shipdate", "n", F.col("shipped").cast("double").alias("shipped"), "earlier", "percent")


@query(f"""
    SELECT l_returnflag, l_orderkey, l_partkey, row_number() OVER w AS n, CAST(sum(l_linenumber) OVER w AS BIGINT) AS upto, lag(l_partkey) OVER w AS previous
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY {_LINE_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def windows_over_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over three keys, each of which holds a share of the rows that no task should have."""
    made = prefix_scan(
        table(spark, sf_dir, "lineitem"), _LINE, ["l_returnflag"], number="n", sums={"upto": F.col("l_linenumber")}, lags={"previous": (F.col("l_partkey"), 1)}
    )
    return made.select("l_returnflag", "l_orderkey", "l_partkey", "n", "upto", "previous")


@query("""
    WITH s AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events),
    t AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s),
    v AS (SELECT user_id, min(ts) AS began, max(ts) AS ended FROM t GROUP BY user_id, session)
    SELECT a.user_id AS a_user, a.began AS a_began, b.user_id AS b_user, b.began AS b_began
    FROM v a JOIN v b ON a.began < b.ended AND a.ended > b.began WHERE a.user_id < b.user_id
""")
def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of different users that overlap: a join on two inequalities."""
    rows = sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 MINUTES").groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"))
    a = rows.select(F.col("user_id").alias("a_user"), F.col("began").alias("a_began"), F.col("ended").alias("a_ended"))
    b = rows.select(F.col("user_id").alias("b_user"), F.col("began").alias("b_began"), F.col("ended").alias("b_ended"))
    return ie_join(a, b, ("a_began", "<", "b_ended"), ("a_ended", ">", "b_began")).where("a_user < b_user").select("a_user", "a_began", "b_user", "b_began")


@query("""
    SELECT l_returnflag, share, CAST(CASE share WHEN 0.01 THEN a WHEN 0.5 THEN b ELSE c END AS DECIMAL(20,6)) AS price FROM (
      SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.999) AS c
      FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())), (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.999 AS DOUBLE))) AS s(share)
""")
def percentiles_of_huge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each return flag's prices and of all prices, without a buffer of a group's values."""
    rows, shares = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), [0.01, 0.5, 0.999]
    each = exact_percentiles(rows, "l_extendedprice", shares, ["l_returnflag"])
    every = exact_percentiles(rows, "l_extendedprice", shares).withColumn("l_returnflag", F.lit(None).cast("string"))
    return each.unionByName(every).select("l_returnflag", "share", F.col("percentile").cast("decimal(20,6)").alias("price"))


@query("""
    SELECT l_partkey, count(*) AS n, true AS not_below, true AS near FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20
""")
def count_min_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the 20 commonest parts against estimates from one sketch, merged from those of the ship months."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.trunc("l_shipdate", "month").alias("month"))
    error = 0.0005
    months = rows.groupBy("month").agg(F.expr(f"count_min_sketch(l_partkey, {error}d, 0.999d, 7)").alias("sketch"))
    one = months.agg(count_min_merge("sketch").alias("sketch"))
    top = rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    made = top.crossJoin(one).crossJoin(total).withColumn("estimate", count_min_estimate("sketch", "l_partkey"))  # tables of one row
    return made.select("l_partkey", "n", (F.col("estimate") >= F.col("n")).alias("not_below"), (F.col("estimate") <= F.col("n") + error * F.col("total")).alias("near"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 0.007 * (SELECT count(*) FROM events)")
def heavy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of more than 0.7 % of all events."""
    return heavy_hitters(table(spark, sf_dir, "events"), "user_id", 0.007)
