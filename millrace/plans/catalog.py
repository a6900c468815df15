"""Queries over the test tables, each with the DuckDB SQL that gives the same rows.

Money is summed as decimals, so that a sum does not depend on its order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import functions as MF
from millrace import streaming
from millrace.operators.asof import asof_join
from millrace.operators.ranges import range_join
from millrace.operators.recursion import reachable
from millrace.operators.sampling import bottom_k
from millrace.operators.skew import salted_join
from millrace.operators.windows import groups_frame, sessions, top_per_group
from millrace.sources import formats, jdbc, layout, rowgroups
from millrace.sources.scratch import scratch_path
from millrace.sources.tables import table
from millrace.streaming import state

from . import aggregates, scalars, scale, shapes  # noqa: F401  they register themselves
from .registry import ORACLE, QUERIES  # noqa: F401
from .registry import query as _query
from .registry import sql as _sql


def _exact(c) -> F.Column:
    return F.col(c).cast("decimal(18,6)") if isinstance(c, str) else c


# ---------------------------------------------------------------- aggregation


@_query("""
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS DOUBLE) AS sum_qty,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,6))) AS DOUBLE) AS sum_base_price,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,6)) * (1 - CAST(l_discount AS DECIMAL(8,6)))) AS DOUBLE) AS sum_disc_price,
      CAST(sum(CAST(l_discount AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = _exact("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(8,6)"))
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_shipdate <= timestamp_ntz'1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(_exact("l_quantity")).cast("double").alias("sum_qty"),
            F.sum(_exact("l_extendedprice")).cast("double").alias("sum_base_price"),
            F.sum(price).cast("double").alias("sum_disc_price"),
            (F.sum(_exact("l_discount")).cast("double") / F.count(F.lit(1))).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


_sql("count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderpriority")
for _kind, _by in (
    ("cube", "CUBE (o_orderstatus, o_orderpriority)"),
    ("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"),
    ("grouping_sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
):
    _sql(
        f"agg_{_kind}",
        f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM {{orders}} GROUP BY {_by}",
    )
_sql(
    "percentiles",
    "SELECT l_returnflag, percentile(l_quantity, 0.5) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 "
    "FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1",
)
_sql(
    "agg_filter",
    "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count_if(o_totalprice <= 100000) AS small FROM {orders} GROUP BY o_orderstatus",
    "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, CAST(count_if(o_totalprice <= 100000) AS BIGINT) AS small FROM orders GROUP BY 1",
)
_sql(
    "max_min_by",
    "SELECT c_nationkey, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS richest, min_by(c_custkey, struct(c_acctbal, c_custkey)) AS poorest FROM {customer} GROUP BY c_nationkey",
    "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY 1",
)
_sql(
    "collect_distinct",
    "SELECT c_nationkey, array_join(array_sort(collect_set(c_mktsegment)), ',') AS segments FROM {customer} GROUP BY c_nationkey",
    "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY 1",
)
_sql(
    "bool_bit_aggregates",
    "SELECT c_mktsegment, bool_and(c_acctbal > -1000) AS b_all, bool_or(c_acctbal > 9000) AS b_any, bit_and(c_custkey) AS k_and, "
    "bit_or(c_custkey) AS k_or, bit_xor(c_custkey) AS k_xor FROM {customer} GROUP BY c_mktsegment",
)
_sql(
    "min_max_any",
    "SELECT p_brand, min(p_size) AS least, max(p_size) AS most, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM {part} GROUP BY p_brand",
)


# ---------------------------------------------------------------------- joins

_sql(
    "inner_join",
    "SELECT n_name, count(*) AS orders FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
)
_sql("left_join", "SELECT o_orderkey, count(l_orderkey) AS n FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey")
_sql("right_join", "SELECT count(o_orderkey) AS n, count(*) AS m FROM {lineitem} RIGHT JOIN {orders} ON o_orderkey = l_orderkey AND l_quantity > 45")
_sql(
    "full_join",
    "SELECT o_orderkey, l_partkey FROM {orders} FULL JOIN {lineitem} ON o_orderkey = l_orderkey AND l_quantity > 49",
)
_sql("semi_join", "SELECT o_orderkey FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
_sql("anti_join", "SELECT o_orderkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)")
_sql("theta_join", "SELECT count(*) AS n FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
_sql("small_product", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")


@_query("""
    SELECT v.event_id, v.user_id, c.event_id AS click_id
    FROM (SELECT * FROM events WHERE event_type = 'view') v
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.ts >= c.ts
""")
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    views = rows.where("event_type = 'view'").select("event_id", "user_id", "ts")
    clicks = rows.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return asof_join(views, clicks, "user_id", "ts", "ts", {"click_id": "event_id"}, block=lambda t: F.date_trunc("day", t)).select("event_id", "user_id", "click_id")


@_query("""
    SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 25
""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    low = F.col("s_acctbal")
    return range_join(customers, suppliers, F.col("c_acctbal"), low, low + 25, 25.0).select("c_custkey", "s_suppkey")


@_query("SELECT c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    joined = salted_join(orders, table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 8)
    return joined.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ subqueries

_sql("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM {orders})")
_sql("in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT')")
_sql(
    "lateral",
    "SELECT r_name, t.n FROM {region}, LATERAL (SELECT count(*) AS n FROM {nation} WHERE n_regionkey = r_regionkey) t",
)
_sql(
    "recursive",
    """WITH RECURSIVE t(conv_id, turn, roles, words) AS (
      SELECT conv_id, turn, CAST(role AS STRING), length(text) FROM {conversations} WHERE turn = 0
      UNION ALL SELECT c.conv_id, c.turn, concat(t.roles, '>', c.role), t.words + length(c.text)
      FROM t JOIN {conversations} c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
    SELECT conv_id, turn, roles, words FROM t""",
    """WITH RECURSIVE t(conv_id, turn, roles, words) AS (
      SELECT conv_id, turn, role, CAST(length(text) AS INT) FROM conversations WHERE turn = 0
      UNION ALL SELECT c.conv_id, c.turn, concat(t.roles, '>', c.role), CAST(t.words + length(c.text) AS INT)
      FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
    SELECT conv_id, turn, roles, words FROM t""",
)
@_query("""
    WITH RECURSIVE e AS (
      SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
    r AS (
      SELECT p_partkey AS node, 0 AS hops FROM part WHERE p_size = 50
      UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 6)
    SELECT node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1
""")
def part_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that the largest ones lead to within six steps, from a line of an order to its next one."""
    rows = table(spark, sf_dir, "lineitem")
    a = rows.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("src"))
    b = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    roots = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("node"))
    return reachable(a.join(b, ["l_orderkey", "n"]), roots, 6)


_sql(
    "pivoted",
    "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, 1 AS one FROM {orders}) PIVOT (count(one) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
    "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, "
    "nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1",
)


@_query("""
    SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS amount FROM part
    UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part
""")
def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "what", "amount")


# --------------------------------------------------------------------- windows

_sql(
    "rankings",
    """SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr,
      CAST(ntile(4) OVER w AS INT) AS nt, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd
    FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
_sql(
    "neighbours",
    """SELECT o_orderkey, lag(o_orderkey, 1, CAST(-1 AS BIGINT)) OVER w AS before, lead(o_orderkey) OVER w AS after,
      first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 2) OVER w AS second
    FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
_sql(
    "rows_frame",
    """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,6))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving FROM {orders}""",
)
_sql(
    "range_frame",
    """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
      RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS recent FROM {orders}""",
)


@_query("""
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n
    FROM orders
""")
def groups_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return groups_frame(rows, ["o_custkey"], "o_orderpriority", 1, 0, {"n": F.count(F.lit(1))}).select("o_orderkey", "n")


@_query("""
    SELECT o_custkey, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2
""")
def top_two_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@_query("""
    SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM (
      SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOUR THEN 1 ELSE 0 END AS fresh FROM events)
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return sessions(rows, "user_id", "ts", "8 HOURS").select("event_id", "session")


# ------------------------------------------------------- sorting and set operations

_sql("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("offset_rows", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 30 OFFSET 40")
_sql(
    "null_order",
    """SELECT 'first' AS nulls, o_orderkey, late FROM (
      SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS late FROM {orders} ORDER BY late DESC NULLS FIRST, o_orderkey LIMIT 20)
    UNION ALL SELECT 'last' AS nulls, o_orderkey, late FROM (
      SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS late FROM {orders} ORDER BY late ASC NULLS LAST, o_orderkey LIMIT 20)""",
)
_sql("union_distinct", "SELECT n_nationkey AS k FROM {nation} UNION SELECT c_nationkey FROM {customer}")
_sql("union_all", "SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT s_nationkey FROM {supplier}")
_sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
_sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
_sql("intersect_distinct", "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT s_suppkey FROM {supplier}")
_sql("except_distinct", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT s_suppkey FROM {supplier}")


@_query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


# ------------------------------------------------------------- scalar functions

_sql(
    "string_functions",
    """SELECT c_custkey, lower(c_name) AS low, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '0', 'o') AS rep, reverse(c_name) AS rev,
      lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '.') AS rp, CAST(instr(c_name, '1') AS BIGINT) AS at, concat_ws('-', c_name, c_mktsegment) AS j,
      md5(c_name) AS m, trim(concat('  ', c_name, ' ')) AS t, CAST(levenshtein(c_mktsegment, 'BUILDING') AS BIGINT) AS lev,
      translate(c_mktsegment, 'AEI', 'aei') AS tr, substring(c_name, 2, 5) AS sub, repeat('ab', 2) AS rpt,
      starts_with(c_name, 'Cust') AS st, left(c_name, 3) AS l3, right(c_name, 3) AS r3, CAST(ascii(c_name) AS INT) AS asc
    FROM {customer}""".replace("starts_with(", "startswith("),
    """SELECT c_custkey, lower(c_name) AS low, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '0', 'o') AS rep, reverse(c_name) AS rev,
      lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '.') AS rp, CAST(instr(c_name, '1') AS BIGINT) AS at, concat_ws('-', c_name, c_mktsegment) AS j,
      md5(c_name) AS m, trim(concat('  ', c_name, ' ')) AS t, CAST(levenshtein(c_mktsegment, 'BUILDING') AS BIGINT) AS lev,
      translate(c_mktsegment, 'AEI', 'aei') AS tr, substring(c_name, 2, 5) AS sub, repeat('ab', 2) AS rpt,
      starts_with(c_name, 'Cust') AS st, left(c_name, 3) AS l3, right(c_name, 3) AS r3, CAST(ascii(c_name) AS INT) AS asc
    FROM customer""",
)
_sql(
    "regular_expressions",
    r"SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS rep, regexp_extract(c_name, '([0-9]+)', 1) AS num, c_mktsegment RLIKE '^[A-F]' AS early FROM {customer}",
    r"SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS rep, regexp_extract(c_name, '([0-9]+)', 1) AS num, regexp_matches(c_mktsegment, '^[A-F]') AS early FROM customer",
)
_sql(
    "date_functions",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d,
      CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(weekofyear(o_orderdate) AS BIGINT) AS w, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy,
      CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, CAST(datediff(DATE'2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age,
      CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next, last_day(CAST(o_orderdate AS DATE)) AS last
    FROM {orders}""",
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q,
      weekofyear(o_orderdate) AS w, dayofyear(o_orderdate) AS doy, dayofweek(o_orderdate) + 1 AS dow,
      date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS age, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next,
      last_day(CAST(o_orderdate AS DATE)) AS last
    FROM orders""",
)
_sql(
    "math_functions",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, abs(-l_linenumber) AS a, CAST(ceil(l_discount * 100) AS BIGINT) AS c,
      CAST(floor(l_tax * 100) AS BIGINT) AS f, sqrt(l_quantity) AS s, CAST(l_linenumber % 3 AS INT) AS r, CAST(sign(l_quantity) AS INT) AS g,
      greatest(l_partkey, l_suppkey) AS big, least(l_partkey, l_suppkey) AS small, l_quantity / nullif(l_discount, 0) AS q
    FROM {lineitem}""",
)
_sql(
    "conditionals",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
      coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, o_orderpriority IN ('1-URGENT', '2-HIGH') AS rush FROM {orders}""",
)
_sql(
    "array_functions",
    """SELECT doc_id, CAST(size(w) AS BIGINT) AS n, array_join(slice(w, 1, 3), ' ') AS head, array_contains(w, 'de') AS has,
      aggregate(transform(w, x -> CAST(length(x) AS BIGINT)), CAST(0 AS BIGINT), (s, x) -> s + x) AS letters, CAST(size(filter(w, x -> length(x) > 5)) AS BIGINT) AS long
    FROM (SELECT doc_id, split(text, ' ') AS w FROM {documents})""",
    """SELECT doc_id, len(w) AS n, array_to_string(w[1:3], ' ') AS head, list_contains(w, 'de') AS has,
      CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS letters, len(list_filter(w, lambda x: length(x) > 5)) AS long
    FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
_sql(
    "exploded",
    "SELECT lang, w, count(*) AS n FROM (SELECT lang, explode(split(text, ' ')) AS w FROM {documents}) WHERE length(w) = 4 GROUP BY lang, w",
    "SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) = 4 GROUP BY ALL",
)
_sql(
    "json_fields",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
_sql(
    "maps",
    "SELECT event_type, map(event_type, CAST(1 AS BIGINT))[event_type] AS one, CAST(size(map_keys(map('a', 1, 'b', 2))) AS BIGINT) AS n FROM {events} GROUP BY event_type",
    "SELECT event_type, CAST(1 AS BIGINT) AS one, len(map_keys(MAP {'a': 1, 'b': 2})) AS n FROM events GROUP BY 1",
)
_sql(
    "time_buckets",
    "SELECT CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS h, event_type, count(*) AS n FROM {events} GROUP BY 1, 2",
    "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)


@_query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,6)), 1) AS DOUBLE) AS r FROM lineitem")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", MF.round_half_up(F.col("l_extendedprice"), 1).alias("r"))


@_query("""
    SELECT a.vec_id, b.vec_id AS other, list_aggregate(list_transform(range(1, 65),
        lambda i: CAST(floor(64 * CAST(a.embedding[i] AS DOUBLE)) * floor(64 * CAST(b.embedding[i] AS DOUBLE)) AS BIGINT)), 'sum')::DOUBLE AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def dot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))))
    a = rows.select("vec_id", F.col("v").alias("a"))
    b = rows.select(F.col("vec_id").alias("other"), F.col("v").alias("b"))
    return a.join(b, F.col("other") == F.col("vec_id") + 1).select("vec_id", "other", MF.dot(F.col("a"), F.col("b")).alias("score"))


# -------------------------------------------------------------- sources and sinks


def _format_query(fmt: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
        return formats.round_trip(rows, fmt)

    run.__name__ = f"format_{fmt}"
    QUERIES[run.__name__] = run
    ORACLE[run.__name__] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


for _fmt in formats.FORMATS:
    _format_query(_fmt)


@_query("SELECT c_name AS line FROM customer")
def format_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.text_lines(table(spark, sf_dir, "customer"), "c_name")


@_query("SELECT c_nationkey, count(*) AS customers, max(c_acctbal) AS most, min(c_custkey) AS first FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def jdbc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written to a database and read back in ranges of their key; on a cluster, by a database for each share of them."""
    customers = table(spark, sf_dir, "customer")
    if jdbc.in_one_process(spark):
        url = jdbc.own_database(spark)
        jdbc.write_table(customers, url, "customer")
        rows = jdbc.read_table(spark, url, "customer", "c_custkey", 4)
    else:
        rows = jdbc.by_databases(customers, "customer")
    rows = rows.where("c_acctbal > 0")
    return rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("most"), F.min("c_custkey").alias("first"))


@_query("SELECT page_id, url, length(html) AS n FROM pages WHERE page_id >= 20")
def python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by a source in Python, which leaves out row groups by their footers."""
    return rowgroups.row_groups(spark, f"{sf_dir}/pages.parquet").where("page_id >= 20").select("page_id", "url", F.length("html").alias("n"))


@_query("SELECT page_id, url FROM pages")
def python_stream_and_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by a stream source and a sink in Python, in two runs: the second one has nothing left to do."""
    base = scratch_path(spark, "rowgroups")
    for _ in range(2):
        rowgroups.copied(spark, f"{sf_dir}/pages.parquet", f"{base}/sink", f"{base}/state")
    return rowgroups.committed(spark, f"{base}/sink", table(spark, sf_dir, "pages").schema).select("page_id", "url")


@_query("""
    SELECT n_name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,6))) AS DOUBLE) AS total FROM customer
    JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1
""")
def partitions_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a folder a nation: which folders are read is known once the nations of a region are."""
    rows = layout.partitioned(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), scratch_path(spark, "by-nation"), "c_nationkey")
    some = table(spark, sf_dir, "nation").where("n_regionkey = 2")
    made = rows.join(some, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name")
    return made.agg(F.count(F.lit(1)).alias("customers"), F.sum(_exact("c_acctbal")).cast("double").alias("total"))


@_query("""
    SELECT o_orderpriority, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def buckets_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed alike: neither the join nor the count by order moves their rows."""
    orders = layout.bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 8)
    lines = layout.bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", 8)
    each = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("o_orderpriority").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("orders"))


@_query("""
    SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6)) * CASE event_type WHEN 'click' THEN 2 ELSE 1 END) AS DOUBLE) AS total
    FROM events WHERE event_type <> 'click' OR user_id >= 10 GROUP BY 1
""")
def partitions_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a folder a type, of which that of the clicks is replaced."""
    rows, path = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type"), scratch_path(spark, "by-type")
    layout.partitioned(rows, path, "event_type")
    layout.replace_partitions(rows.where("event_type = 'click' AND user_id >= 10").withColumn("value", F.col("value") * 2), path, "event_type")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(_exact("value")).cast("double").alias("total"))


# ------------------------------------------------------------- user-defined functions


@_query("SELECT c_custkey, c_acctbal * 2 + 1 AS y FROM customer")
def vectorised_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def affine(s):
        return s * 2 + 1

    return table(spark, sf_dir, "customer").select("c_custkey", affine("c_acctbal").alias("y"))


@_query("SELECT c_nationkey, max(c_custkey) - min(c_custkey) AS spread FROM customer GROUP BY 1")
def grouped_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spread(pdf):
        return pdf.groupby("c_nationkey", as_index=False).agg(spread=("c_custkey", lambda s: s.max() - s.min()))

    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return rows.groupBy("c_nationkey").applyInPandas(spread, "c_nationkey int, spread long")


@_query("SELECT n_nationkey, unnest(range(3)) AS i FROM nation")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="i bigint")
    class Three:
        def eval(self, k: int):
            for i in range(3):
                yield (i,)

    return table(spark, sf_dir, "nation").lateralJoin(Three(F.col("n_nationkey").outer())).select("n_nationkey", "i")


_sql(
    "map_functions",
    """SELECT c_custkey, map_contains_key(m, 'seg') AS has, m['seg'] AS seg, CAST(size(map_concat(m, map('x', 'y'))) AS BIGINT) AS n,
      array_join(array_sort(map_keys(map_filter(m, (k, v) -> k <> 'seg'))), ',') AS others, transform_values(m, (k, v) -> upper(v))['seg'] AS up,
      element_at(str_to_map('a:1,b:2', ',', ':'), 'b') AS two
    FROM (SELECT c_custkey, map('seg', c_mktsegment, 'nat', CAST(c_nationkey AS STRING)) AS m FROM {customer})""",
    """SELECT c_custkey, true AS has, c_mktsegment AS seg, CAST(3 AS BIGINT) AS n, 'nat' AS others, upper(c_mktsegment) AS up, '2' AS two FROM customer""",
)
_sql(
    "json_and_csv",
    """SELECT event_id, from_json(props, 'k BIGINT').k AS k, to_json(named_struct('u', user_id)) AS j, from_csv(concat(event_id, ',', event_type), 'a BIGINT, b STRING').b AS b,
      CAST(json_array_length('[1,2,3]') AS BIGINT) AS three, variant_get(parse_json(props), '$.k', 'bigint') AS vk
    FROM {events}""",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"u":' || user_id || '}' AS j, event_type AS b, CAST(3 AS BIGINT) AS three,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS vk
    FROM events""",
)
_sql(
    "more_aggregates",
    """SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, count_if(l_quantity > 25) AS c, mode(l_linenumber, true) AS md,
      median(l_quantity) AS med, CAST(regr_count(l_tax, l_discount) AS BIGINT) AS rc, array_join(array_sort(collect_list(DISTINCT l_linestatus)), '') AS st
    FROM {lineitem} GROUP BY l_returnflag""",
    """SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, CAST(count_if(l_quantity > 25) AS BIGINT) AS c,
      (SELECT l_linenumber FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS md,
      median(l_quantity) AS med, CAST(count(*) AS BIGINT) AS rc, array_to_string(list_sort(list(DISTINCT l_linestatus)), '') AS st
    FROM lineitem o GROUP BY l_returnflag""",
)
_sql(
    "array_sets",
    """SELECT n_nationkey, array_join(array_union(a, b), ',') AS u, array_join(array_intersect(a, b), ',') AS i, array_join(array_except(a, b), ',') AS e,
      arrays_overlap(a, b) AS o, CAST(array_position(a, 2) AS BIGINT) AS p, array_max(a) AS mx, array_min(b) AS mn, forall(a, x -> x > 0) AS all_pos, exists(b, x -> x = 5) AS five,
      CAST(size(flatten(array(a, b))) AS BIGINT) AS n
    FROM (SELECT n_nationkey, array(1, 2, 3) AS a, array(3, CAST(n_nationkey % 7 AS INT)) AS b FROM {nation})""",
    """SELECT n_nationkey, array_to_string(CASE WHEN k IN (1, 2, 3) THEN [1, 2, 3] ELSE [1, 2, 3, k] END, ',') AS u, array_to_string(list_filter(a, lambda x: x IN (3, k)), ',') AS i,
      array_to_string(list_filter(a, lambda x: x NOT IN (3, k)), ',') AS e, true AS o, CAST(2 AS BIGINT) AS p, 3 AS mx, least(3, k) AS mn, true AS all_pos, k = 5 AS five, CAST(5 AS BIGINT) AS n
    FROM (SELECT n_nationkey, [1, 2, 3] AS a, CAST(n_nationkey % 7 AS INT) AS k FROM nation)""",
)
_sql(
    "last_values",
    """SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest,
      CAST(avg(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey) AS DOUBLE) > 0 AS pos FROM {orders}""",
)
_sql(
    "guarded_arithmetic",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, try_divide(l_quantity, l_discount) AS q, try_add(l_linenumber, 1) AS n FROM {lineitem}",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS q, l_linenumber + 1 AS n FROM lineitem",
)
_sql(
    "time_arithmetic",
    """SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s, date_add(CAST(ts AS DATE), 7) AS week,
      date_format(ts, 'yyyy-MM-dd') AS day, add_months(CAST(ts AS DATE), 2) AS later, make_date(year(ts), 1, 1) AS first
    FROM {events}""",
    """SELECT event_id, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, CAST(ts AS DATE) + 7 AS week, strftime(ts, '%Y-%m-%d') AS day,
      CAST(CAST(ts AS DATE) + INTERVAL 2 MONTH AS DATE) AS later, make_date(year(ts), 1, 1) AS first
    FROM events""",
)


@_query("SELECT n_nationkey, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_nationkey": a["n_nationkey"], "customers": len(b)})

    nations = table(spark, sf_dir, "nation").select("n_nationkey").groupBy("n_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").groupBy("c_nationkey")
    return nations.cogroup(customers).applyInPandas(count, "n_nationkey int, customers long")


@_query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer")
def arrow_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    def sums(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "total": [pc.sum(b.column(0)).as_py()]})

    parts = table(spark, sf_dir, "customer").select("c_custkey").mapInArrow(sums, "n long, total long")
    return parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@_query("""
    WITH q AS (
      SELECT o_orderkey, o_orderstatus, o_totalprice,
        (CAST('0x' || substr(md5('sample|' || CAST(o_orderkey AS VARCHAR)), 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) / o_totalprice AS q
      FROM orders WHERE o_totalprice > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY q, o_orderkey) AS k FROM q),
    b AS (SELECT o_orderstatus, max(q) FILTER (k = 51) AS bar FROM r GROUP BY 1)
    SELECT o_orderkey, o_orderstatus, CAST(coalesce(greatest(o_totalprice, 1 / bar), o_totalprice) AS DECIMAL(20,4)) AS price FROM r JOIN b USING (o_orderstatus) WHERE k <= 50
""")
def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 orders of each status, likelier the higher their price, with what they stand for."""
    made = bottom_k(table(spark, sf_dir, "orders"), 50, ["o_orderkey"], ["o_orderstatus"], "o_totalprice")
    return made.select("o_orderkey", "o_orderstatus", F.col("estimate").cast("decimal(20,4)").alias("price"))


@_query("SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS width FROM customer GROUP BY 1")
def pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def width(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(width("c_acctbal").alias("width"))


# ------------------------------------------------------------------------ streaming


@_query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total
    FROM events GROUP BY ALL
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.windowed(spark, sf_dir, "1 hour")


@_query("""
    SELECT started, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM (
      SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS started, * FROM events, (SELECT unnest([0, 1]) AS i))
    GROUP BY ALL
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.windowed(spark, sf_dir, "1 hour", "30 minutes")


@_query("""
    SELECT user_id, min(ts) AS started, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
        SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh FROM events))
    GROUP BY user_id, s
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.sessions(spark, sf_dir, "4 hours")


@_query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.first_seen(spark, sf_dir)


@_query("""
    SELECT c.user_id, c.event_id AS click_id, p.event_id FROM events c JOIN events p
    ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR
""")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.purchases_after_clicks(spark, sf_dir)


@_query("SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.running_totals(spark, sf_dir)


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.without_late_rows(spark, sf_dir)


@_query("""
    SELECT u.user_id, n, array_to_string(list_sort(list_slice(ids, len(ids) - 2, len(ids))), ',') AS last, types FROM (
      SELECT user_id, count(*) AS n, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1) u
    JOIN (SELECT user_id, string_agg(event_type || '=' || k, ',' ORDER BY event_type) AS types FROM (
      SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL) GROUP BY 1) t ON t.user_id = u.user_id
""")
def stream_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.profiles(spark, sf_dir)


@_query("SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1")
def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.farewells(spark, sf_dir)


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.after_a_restart(spark, sf_dir)


@_query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.in_memory(spark, sf_dir)


@_query("SELECT count(*) AS kept, count(*) AS dropped FROM events")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.kept_and_dropped(spark, sf_dir)


@_query("SELECT event_id, event_type FROM events")
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.at_the_rate_of(spark, sf_dir)


@_query("SELECT user_id, count(*) AS n, count(*) AS kept FROM events WHERE event_id % 2 = 1 GROUP BY 1")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.after_expiry(spark, sf_dir)


@_query("""
    SELECT c.user_id, c.event_id AS click_id, p.event_id FROM (SELECT * FROM events WHERE event_type = 'click') c
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR
""")
def stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.clicks_with_and_without_purchase(spark, sf_dir)
