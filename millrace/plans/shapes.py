"""Queries over join strategies, order within partitions, sampling, reshaping and the remaining kinds of user-defined functions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import table

from .registry import query, sql

# a hint chooses how a join runs, never what it gives; broadcasting is for a side of proven size
for _hint in ("BROADCAST(n)", "MERGE(n)", "SHUFFLE_HASH(n)", "SHUFFLE_REPLICATE_NL(n)"):
    sql(
        f"join_{_hint.split('(')[0].lower()}",
        f"SELECT /*+ {_hint} */ n_name, count(*) AS customers FROM {{customer}} c JOIN {{nation}} n ON c_nationkey = n_nationkey GROUP BY n_name",
        "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    )
sql(
    "inequality_join",
    """SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN (SELECT * FROM {nation}) b
    ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 5""",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 5",
)


@query("SELECT true AS ordered, true AS apart, count(*) AS n FROM orders")
def range_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by ranges and sorted within partitions: no partition reaches into the next, no row precedes its predecessor."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    dealt = rows.repartitionByRange(6, "o_custkey", "o_orderkey").sortWithinPartitions("o_custkey", "o_orderkey")

    def look(batches):
        last, first, ok, n = None, None, True, 0
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            if keys:
                ok = ok and keys == sorted(keys) and (last is None or last <= keys[0])
                first, last, n = first or keys[0], keys[-1], n + len(keys)
        if n:
            yield pa.RecordBatch.from_pylist([{"lo": first[0], "lo2": first[1], "hi": last[0], "hi2": last[1], "ok": ok, "n": n}])

    parts = dealt.mapInArrow(look, "lo long, lo2 long, hi long, hi2 long, ok boolean, n long")
    each = F.array_sort(F.collect_list(F.struct("lo", "lo2", "hi", "hi2")))
    made = parts.agg(F.bool_and("ok").alias("ordered"), each.alias("p"), F.sum("n").alias("n"))
    apart = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.col("p")[i - 1]["hi"], F.col("p")[i - 1]["hi2"]) < F.struct(F.col("p")[i]["lo"], F.col("p")[i]["lo2"]))
    return made.select("ordered", apart.alias("apart"), "n")


@query("""
    SELECT count(*) AS n, true AS whole, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f, true AS o_share,
      (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') * 0 AS p FROM orders
""")
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is certain of samples: splits add up, a share of 1 takes all of a stratum, of 0 none, of a half near a half."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    a, b, c = rows.randomSplit([0.5, 0.3, 0.2], seed=3)
    split = a.unionByName(b).unionByName(c).agg(F.count(F.lit(1)).alias("k"), F.count_distinct("o_orderkey").alias("d"))
    some = rows.sampleBy("o_orderstatus", {"F": 1.0, "O": 0.5, "P": 0.0}, seed=5)
    taken = some.agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("all_o"))
    return whole.crossJoin(split).crossJoin(taken).select(  # three tables of one row
        "n",
        ((F.col("k") == F.col("n")) & (F.col("d") == F.col("n"))).alias("whole"),
        "f",
        (F.abs(F.col("o") - F.col("all_o") / 2) <= 5 * F.sqrt(F.col("all_o")) / 2).alias("o_share"),
        "p",
    )


@query("SELECT 'n' AS key, count(*) FILTER (WHERE n_regionkey = 0) AS \"0\", count(*) FILTER (WHERE n_regionkey = 1) AS \"1\", "
       "count(*) FILTER (WHERE n_regionkey = 2) AS \"2\", count(*) FILTER (WHERE n_regionkey = 3) AS \"3\", count(*) FILTER (WHERE n_regionkey = 4) AS \"4\" FROM nation")  # fmt: skip
def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).transpose("n_regionkey")


@query("SELECT n_nationkey, length(n_name) * 2 + n_regionkey AS y FROM nation")
def row_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row-at-a-time function: for logic that neither built-in nor vectorised functions express, on small tables."""

    @F.udf("long")
    def twice(name: str | None, region: int | None):
        return None if name is None or region is None else len(name) * 2 + region

    return table(spark, sf_dir, "nation").select("n_nationkey", twice("n_name", "n_regionkey").alias("y"))


@query("SELECT c_custkey, upper(c_mktsegment) AS u, c_acctbal + 1 AS y FROM customer")
def arrow_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("string")
    def upper(x: pa.Array) -> pa.Array:
        return pc.utf8_upper(x)

    @F.arrow_udf("double")
    def more(x: pa.Array) -> pa.Array:
        return pc.add(x, 1.0)

    return table(spark, sf_dir, "customer").select("c_custkey", upper("c_mktsegment").alias("u"), more("c_acctbal").alias("y"))


@query("SELECT n_nationkey AS k, n_nationkey * n_nationkey AS square FROM nation")
def arrow_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udtf(returnType="k long, square long")
    class Squares:
        def eval(self, rows: pa.RecordBatch):
            k = rows.column(0).cast(pa.int64())
            yield pa.table({"k": k, "square": pc.multiply(k, k)})

    spark.udtf.register("squares_of", Squares)
    return spark.sql("SELECT * FROM squares_of(TABLE(SELECT n_nationkey FROM {n}))", n=table(spark, sf_dir, "nation"))


@query("SELECT item_id, CAST(length(text) AS BIGINT) AS n FROM benchmark")
def benchmark_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.length("text").cast("long").alias("n"))


sql(
    "conversation_turns",
    """SELECT conv_id, count(*) AS turns, array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), ',') AS roles,
      max_by(length(text), turn) AS last_length FROM {conversations} GROUP BY conv_id""",
    """SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, CAST(arg_max(length(text), turn) AS INT) AS last_length FROM conversations GROUP BY 1""",
)
