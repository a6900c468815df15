"""Where queries and their DuckDB texts are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function as the query of its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register Spark SQL over tables in braces; ``oracle``: DuckDB's text where the dialects differ."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = oracle or re.sub(r"\{(\w+)\}", r"\1", text)
