from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest

from conftest import HERE
from millrace.plans import catalog
from millrace.sources import jdbc
from oracle import rows

ON_A_CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
from millrace.plans import catalog
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false")
spark = spark.config("spark.checkpoint.dir", f"file://{sys.argv[1]}/shared").config("spark.local.dir", sys.argv[1]).getOrCreate()
found = catalog.QUERIES["jdbc_round_trip"](spark, sys.argv[2])
again = [sorted(map(list, found.collect())) for _ in range(2)]
print(json.dumps([found.columns, *again]))
spark.stop()
"""


def test_round_trip_where_tasks_run_in_other_processes(small, tmp_path):
    made = subprocess.run(
        [sys.executable, "-c", ON_A_CLUSTER, str(tmp_path), small], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(HERE.parent)}, capture_output=True, text=True, timeout=300
    )
    assert made.returncode == 0, made.stderr[-2000:]
    names, *found = json.loads(made.stdout.splitlines()[-1])
    want_names, want = rows(catalog.ORACLE["jdbc_round_trip"], small)
    assert names == want_names and found == [sorted(map(list, want))] * 2


def test_databases_of_shares_give_back_odd_values(spark):
    texts = ["", None, " lead", "trail ", "a,b", 'q"q', '""', "x\ny", "\r\n", "é😀", "\\", '\\"', "\t", "  ", "'", 'a"b,c\nd', '"', ",", "null", "\x01"]
    made = [(i, s, i / 7 if i % 3 else None, None if i % 5 else i % 2 == 0) for i, s in enumerate(texts)] + [(None, "n", 1e300, True)] * 2
    df = spark.createDataFrame(made, "k long, `a s` string, x double, b boolean").selectExpr("*", "date'1999-12-31' d", "cast(k + 0.005 as decimal(10,3)) m", "float(0.1) f")
    back = jdbc.by_databases(df, "odd", 3)
    assert back.columns == df.columns and back.rdd.getNumPartitions() == 3
    assert sorted(back.collect(), key=repr) == sorted(df.collect(), key=repr)
    assert "*GreaterThan(k,3)" in back.where("k > 3")._jdf.queryExecution().executedPlan().toString()
    assert jdbc.by_databases(df.limit(0), "nobody").count() == 0
    with pytest.raises(ValueError, match="no exact text"):
        jdbc.by_databases(df.selectExpr("k", "binary(`a s`) y"), "odd")
