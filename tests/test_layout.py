from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from millrace.plans import catalog
from millrace.sources import jdbc, layout, rowgroups


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().toString()


def test_folders_are_pruned_when_the_small_side_is_known(spark, small):
    plan = _plan(catalog.QUERIES["partitions_pruned"](spark, small))
    assert "dynamicpruning" in plan.lower()


def test_bucketed_tables_join_without_an_exchange(spark, small):
    df = catalog.QUERIES["buckets_joined"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(o_orderpriority" in plan


def test_other_partitions_are_left_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("k"))
    layout.partitioned(rows, path, "k")
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("k=")}
    layout.replace_partitions(rows.where("k = 1 AND id < 30"), path, "k")
    after = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("k=")}
    assert before.keys() == after.keys() and [d for d in before if before[d] != after[d]] == ["k=1"]
    assert spark.read.parquet(path).groupBy("k").count().where("k = 1").first()["count"] == 10
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_row_groups_are_left_out_by_their_footers(spark, tmp_path):
    t = pa.table({"n": list(range(1000)), "s": [f"{i:04}" for i in range(1000)]})
    pq.write_table(t, f"{tmp_path}/a.parquet", row_group_size=100)
    read = rowgroups.row_groups(spark, str(tmp_path))
    for condition, groups, n in (("n >= 850", 2, 150), ("s = '0123'", 1, 1), ("n IN (5, 995)", 2, 2), ("n > 5 AND n <= 99", 1, 94), ("n < 0", 1, 0), ("n + 1 = 7", 10, 1)):
        df = read.where(condition)
        assert (df.rdd.getNumPartitions(), df.count()) == (groups, n)
    assert sorted(r.n for r in read.collect()) == list(range(1000))


def test_a_stream_of_row_groups_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where = [f"{tmp_path}/{x}" for x in ("in", "out", "state")]

    def add(name, first):
        pq.write_table(pa.table({"n": list(range(first, first + 50))}), f"{tmp_path}/in/{name}.parquet", row_group_size=10)

    def there():
        return sorted(r.n for r in rowgroups.committed(spark, where[1], spark.read.parquet(where[0]).schema).collect())

    add("a", 0)
    rowgroups.copied(spark, *where)
    assert there() == list(range(50)) and len(os.listdir(f"{tmp_path}/out/batches")) >= 1
    rowgroups.copied(spark, *where)
    assert there() == list(range(50))
    add("b", 50)
    rowgroups.copied(spark, *where)
    assert there() == list(range(100))


def test_a_database_reads_in_ranges_and_filters(spark, small):
    url = jdbc.own_database(spark)
    rows = spark.read.parquet(f"{small}/customer.parquet")
    jdbc.write_table(rows, url, "customer")
    back = jdbc.read_table(spark, url, "customer", "c_custkey", 4)
    assert back.rdd.getNumPartitions() == 4 and sorted(back.columns) == sorted(rows.columns)
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    plan = catalog.QUERIES["jdbc_round_trip"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "*GreaterThan(c_acctbal" in plan
    empty = rows.limit(0)
    jdbc.write_table(empty, url, "nobody")
    assert jdbc.read_table(spark, url, "nobody", "c_custkey").count() == 0
