"""What the operators share: scratch tables in the cluster's shared folder and column-adding Arrow maps."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.sources import scratch

#: Rows that scans and Arrow hold at a time while texts are read.
BATCH_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}
#: Bytes of Arrow data turned into Python objects at a time.
PIECE_BYTES = 2 << 20


#: Paths made within a scope, and the scopes that are open in each thread.
_scopes: dict[str, list[str]] = {}
_thread = threading.local()


def _open() -> list[str]:
    if not hasattr(_thread, "open"):
        _thread.open = []
    return _thread.open


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Note the scratch paths made within, for :func:`release`."""
    _open().append(name)
    try:
        yield
    finally:
        _open().pop()


def release(spark: SparkSession, name: str) -> None:
    """Delete what was made within a scope. Results that read it must have been written by now."""
    for path in _scopes.pop(name, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, noted for the thread's open scope."""
    path = scratch.scratch_path(spark, tag)
    if _open():
        _scopes.setdefault(_open()[-1], []).append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For reads of long texts: readers and Arrow hold a few hundred rows at a time, not thousands."""
    before = {k: spark.conf.get(k) for k in BATCH_ROWS}
    try:
        for k, v in BATCH_ROWS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    ``narrow``: a table of a few numbers a row, written as no more files than the cluster has cores.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with small_batches(spark):
        (df.coalesce(max(1, spark.sparkContext.defaultParallelism)) if narrow else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_millrace_path", None):
            _delete(t.sparkSession, path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that a result column of the same name (in any case) would clash with."""
    gone = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in gone]
    return df if len(kept) == len(df.columns) else df.select(*[f"`{c}`" for c in kept])


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes, or of one row where a row is larger."""
    if batch.num_rows <= 1 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in groups of ``least`` bytes or a little more; larger batches in slices."""
    held, size = [], 0
    for batch in (p for whole in batches for p in pieces(whole, least)):
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield held
            held, size = [], 0
    if held:
        yield held


def add_columns(
    df: DataFrame,
    source: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list[pa.Array]]],
    piece_bytes: int = PIECE_BYTES,
    ahead_bytes: int | None = None,
) -> DataFrame:
    """Append columns computed by Python from one column; all others pass through Arrow untouched.

    ``make()`` runs once a task and returns a function from the values of at most
    ``piece_bytes`` of rows to one Arrow array per field. A column of ``df`` named like a field is replaced.
    With ``ahead_bytes``, its attribute ``ahead`` is first called with all values of that many
    bytes of rows, and then it is for each piece of them.
    """
    if source.lower() in {f.name.lower() for f in fields}:
        raise ValueError(f"the source column {source} can't be a result column")
    base = without(df, [f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])
    at = [c.lower() for c in base.columns].index(source.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for group in gathered(batches, ahead_bytes or piece_bytes):
            if ahead_bytes:
                f.ahead(x for g in group for p in pieces(g, piece_bytes) for x in p.column(at).to_pylist())
            for batch in (p for g in group for p in pieces(g, piece_bytes)):
                made = f(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *made], names=[*batch.schema.names, *(x.name for x in fields)]
                )

    return base.mapInArrow(run, schema)
