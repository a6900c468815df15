"""Tables of databases by JDBC: written in parallel, read in ranges of a key, filters left to the database."""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import scratch_path

#: Types whose text Derby's import reads back as the same value.
TEXTUAL = (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType, T.DateType)


def in_one_process(spark: SparkSession) -> bool:
    """Whether driver and tasks share a process, and so a database in its memory."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def own_database(spark: SparkSession) -> str:
    """The address of a new database in memory of Spark's embedded Derby. It lives in one process, so local sessions alone can use it."""
    if not in_one_process(spark):
        raise ValueError("a database in memory is seen by its own process only; give the address of a server")
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def write_table(df: DataFrame, url: str, name: str, **options: str) -> None:
    """``df`` as a table; each partition writes over a connection of its own."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode("overwrite").save()


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """The table, read in ``parts`` ranges of a numeric ``key``, over as many connections; filters are pushed down.

    The key's bounds are asked of the database first; rows with a null key are in the first range.
    """
    base = {"url": url, "dbtable": name, **options}
    if key:
        low, high = spark.read.format("jdbc").options(**base).load().agg(F.min(key), F.max(key)).first()
        if low is not None and low < high:
            base |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**base).load()


def _gone(spark: SparkSession, url: str) -> None:
    """Drop the driver's copy of a database in memory; Derby reports that as an error with state 08006."""
    try:
        spark._jvm.java.sql.DriverManager.getConnection(f"{url};drop=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":
            raise


def by_databases(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df`` as a table of embedded databases, one for each of ``parts`` equal shares, read back by JDBC with filters pushed down.

    For clusters without a database server: Derby takes no connections from other processes. So the driver makes the
    empty table and backs it up to the shared folder, which must be a path that all see, rows go there as delimited
    text, and the task that reads a share restores the backup in its own memory, has the database import the share's
    file, and asks it. A task that runs again, anywhere, does the same again. Rows never pass the driver; together the
    executors hold the table in memory until they end.
    """
    spark = df.sparkSession
    if odd := [f.name for f in df.schema if not isinstance(f.dataType, TEXTUAL)]:
        raise ValueError(f"no exact text for columns {odd}")
    base = scratch_path(spark, "jdbc")
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        raise ValueError("an embedded database reads files; spark.checkpoint.dir must be a folder that is mounted everywhere")
    folder = where.toUri().getPath()
    made = f"jdbc:derby:memory:{uuid.uuid4().hex}"
    write_table(spark.createDataFrame([], df.schema), f"{made};create=true", name)
    connection = spark._jvm.java.sql.DriverManager.getConnection(made)
    try:
        backup = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_BACKUP_DATABASE(?)")
        backup.setString(1, f"{folder}/empty")
        backup.execute()
    finally:
        connection.close()
    _gone(spark, made)

    def said(f: T.StructField) -> F.Column:
        text = F.col(f"`{f.name}`").cast("string")
        if isinstance(f.dataType, T.StringType):
            text = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(text, F.lit(""))

    shares = df.repartition(parts or spark.sparkContext.defaultParallelism)
    shares.select(F.concat_ws(",", *[said(f) for f in df.schema])).write.text(f"{base}/rows")
    files = [x.getPath().toUri().getPath() for x in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/rows"))]
    tables = []
    for file in sorted(f for f in files if f.rsplit("/", 1)[1].startswith("part-")):
        url = f"jdbc:derby:memory:{uuid.uuid4().hex}"
        quoted = file.replace("'", "''")
        load = f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{quoted}', ',', '\"', 'UTF-8', 1)"
        tables.append(read_table(spark, f"{url};createFrom={folder}/empty/{made.rsplit(':', 1)[1]}", name, sessionInitStatement=load))
        _gone(spark, url)
    return reduce(DataFrame.unionAll, tables)
