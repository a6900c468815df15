"""Round trips through file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch_path

FORMATS = ("parquet", "orc", "json", "csv", "xml")


def round_trip(df: DataFrame, fmt: str) -> DataFrame:
    """Write in a format to the shared folder and read back with the same schema."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "formats")
    options = {"xml": {"rowTag": "row"}, "csv": {"header": "true"}}.get(fmt, {})
    df.write.format(fmt).options(**options).save(path)
    return spark.read.format(fmt).options(**options).schema(df.schema).load(path)


def text_lines(df: DataFrame, column: str) -> DataFrame:
    """The lines of a text column after a round trip through text files."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "formats")
    df.select(F.col(column).alias("value")).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")
