"""A data source in Python with planning of its own: Parquet row groups, pruned by footers, as batches or as a stream; and a sink that commits.

``format("millrace_rowgroups")`` has an option ``path``, a file or folder that pyarrow's file systems reach. Filters that compare
a column with a value are looked up in the footers' statistics, so row groups that can't match are not read;
Spark applies the filters to the rows again. A stream's batch is what is new; its offset is a number of
row groups in order of file names, so new files must have later names.

``format("millrace_commits")`` writes a stream's batches to ``path``: tasks write files under names of their own, and
a batch counts once its list of files is in place; a batch that is run again replaces its list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

PUSH = "spark.sql.python.filterPushdown.enabled"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    fs, at = _opened(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [at]
    found = fs.get_file_info(pafs.FileSelector(at))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".parquet"))


def _may_match(low, high, filters: list) -> bool:
    """Whether a value within low .. high can meet all filters."""
    for f in filters:
        x = f.value
        if isinstance(f, EqualTo) and not low <= x <= high:
            return False
        if isinstance(f, In) and not any(low <= v <= high for v in x if v is not None):
            return False
        if isinstance(f, GreaterThan) and not high > x or isinstance(f, GreaterThanOrEqual) and not high >= x:
            return False
        if isinstance(f, LessThan) and not low < x or isinstance(f, LessThanOrEqual) and not low <= x:
            return False
    return True


class RowGroups(InputPartition):
    def __init__(self, path: str, file: str, group: int) -> None:
        super().__init__((file, group))
        self.path, self.file, self.group = path, file, group


def _all_groups(path: str) -> list[tuple[RowGroups, pq.RowGroupMetaData]]:
    fs, _ = _opened(path)
    out = []
    for file in _files(path):
        meta = pq.read_metadata(file, filesystem=fs)
        out += [(RowGroups(path, file, g), meta.row_group(g)) for g in range(meta.num_row_groups)]
    return out


def _read(part: RowGroups, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    fs, _ = _opened(part.path)
    with pq.ParquetFile(part.file, filesystem=fs) as f:
        yield from f.read_row_group(part.group, columns=schema.names).cast(schema).to_batches(4096)


class RowGroupSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_rowgroups"

    def schema(self) -> StructType:
        path = self.options["path"]
        return from_arrow_schema(pq.read_schema(_files(path)[0], filesystem=_opened(path)[0]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return RowGroupReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RowGroupStream(self.options["path"], schema)


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.arrow, self.filters = path, to_arrow_schema(schema), []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1:
                self.filters.append(f)
            yield f  # statistics only rule row groups out, so Spark looks at the rows

    def partitions(self) -> list[InputPartition]:
        out = []
        for part, meta in _all_groups(self.path):
            columns = {meta.column(i).path_in_schema: meta.column(i).statistics for i in range(meta.num_columns)}

            def fits(name: str, filters: list, columns: dict = columns) -> bool:
                s = columns.get(name)
                return s is None or not s.has_min_max or _may_match(s.min, s.max, filters)

            if all(fits(name, [f for f in self.filters if f.attribute[0] == name]) for name in {f.attribute[0] for f in self.filters}):
                out.append(part)
        return out or [RowGroups("", "", -1)]  # Spark wants one at least

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        if partition.group >= 0:
            yield from _read(partition, self.arrow)


class RowGroupStream(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.arrow = path, to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"groups": 0}

    def latestOffset(self) -> dict:
        return {"groups": len(_all_groups(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [part for part, _ in _all_groups(self.path)[start["groups"] : end["groups"]]]

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        yield from _read(partition, self.arrow)

    def commit(self, end: dict) -> None:
        pass  # files stay where they are


class CommitSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_commits"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return CommitWriter(self.options["path"], schema)


class Written(WriterCommitMessage):
    def __init__(self, file: str, rows: int) -> None:
        self.file, self.rows = file, rows


class CommitWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.arrow = path, to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _opened(self.path)
        fs.create_dir(f"{at}/files", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.parquet", 0
        with pq.ParquetWriter(f"{at}/files/{name}", self.arrow, filesystem=fs) as out:
            for b in iterator:
                rows += b.num_rows
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, self.arrow, strict=True)], schema=self.arrow))
        return Written(name, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, at = _opened(self.path)
        fs.create_dir(f"{at}/batches", recursive=True)
        with fs.open_output_stream(f"{at}/batches/.{batchId}") as f:
            f.write(json.dumps([[m.file, m.rows] for m in messages if m]).encode())
        fs.move(f"{at}/batches/.{batchId}", f"{at}/batches/{batchId}.json")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, at = _opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{at}/files/{m.file}")


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the batches that were committed to ``path``."""
    fs, at = _opened(path)
    lists = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{at}/batches", allow_not_found=True)) if f.base_name.endswith(".json")]
    files = [name for p in lists for name, rows in json.loads(fs.open_input_stream(p).read()) if rows]
    base = path.rstrip("/")
    return spark.read.schema(schema).parquet(*[f"{base}/files/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """The rows of Parquet files through the source; filters on it are pushed into its planning."""
    spark.dataSource.register(RowGroupSource)
    spark.conf.set(PUSH, "true")
    return spark.read.format("millrace_rowgroups").option("path", path).load()


def copied(spark: SparkSession, source: str, sink: str, state: str) -> None:
    """Stream what is new in ``source`` to ``sink``; ``state`` remembers how far earlier runs came."""
    spark.dataSource.register(RowGroupSource)
    spark.dataSource.register(CommitSink)
    stream = spark.readStream.format("millrace_rowgroups").option("path", source).load()
    query = stream.writeStream.format("millrace_commits").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
