"""Connectors written against Spark's Python Data Source API, and the one this library brings.

A connector of one's own is a ``DataSource`` whose reader names its partitions and yields Arrow batches,
and whose writer commits or aborts as a whole. Registered under a name it is a Spark format like any
other: ``spark.read.format(name)``, ``df.write.format(name)``. :class:`PluginSource` puts such a format
behind the source contract, so windows, tenant filters, bookkeeping and sinks work on it unchanged.

The source hands the stream's own filters to the reader as the option ``filters``, a JSON list of column,
operator and value, which a reader may apply before rows leave it; Spark applies all of them in any
case. The API's own ``pushFilters`` is not used: Spark 4.1 keeps the reader of one plan of a DataFrame for
its next, and a plan without filters would get the filters of the one before.

``tablesync-jsonl`` is the connector that comes along: folders of JSON lines, compressed or not, read one
partition per file, through pyarrow's file systems (shared mounts, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import json
import operator
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from tablesync.sources.base import Source, inspect_schemas
from tablesync.spec import StreamSpec

#: Rows of an Arrow batch.
BATCH_ROWS = 4_096

#: Operators of the ``filters`` option; NULL meets none of them.
OPERATORS: dict[str, Callable[[Any, Any], bool]] = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}

#: Types that a file holds as they are; dates and the like are texts there, which Spark compares.
_PLAIN = {T.LongType: int, T.IntegerType: int, T.StringType: str, T.BooleanType: bool}


@dataclass
class FilePartition(InputPartition):
    """One file."""

    path: str


@dataclass
class Written(WriterCommitMessage):
    """The staged file of one task, and its rows."""

    staged: str
    rows: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """The tables' files in a folder; hidden ones are staged."""
    store, folder = _store(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name[0] not in "._" and f.base_name.endswith((".jsonl", ".jsonl.gz")))


class JsonLinesReader(DataSourceReader):
    """Reads one file per task; filters on numbers, texts and booleans are applied before rows leave Python."""

    def __init__(self, schema: T.StructType, path: str, filters: Sequence[Sequence[Any]] = ()):
        self.schema, self.path = schema, path
        plain = {f.name: _PLAIN.get(type(f.dataType)) for f in schema.fields}
        self.filters = [(name, op, value) for name, op, value in filters if type(value) is plain.get(name)]

    def keeps(self, row: dict) -> bool:
        """Does a row meet the filters?"""
        return all(row.get(name) is not None and OPERATORS[op](row[name], value) for name, op, value in self.filters)

    def partitions(self) -> Sequence[InputPartition]:
        return [FilePartition(f) for f in _files(self.path)] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        kind, rows = to_arrow_schema(self.schema), []
        if partition.path:
            with _store(self.path)[0].open_input_stream(partition.path) as stream:
                for line in io.TextIOWrapper(stream, encoding="utf-8"):
                    row = json.loads(line) if line.strip() else None
                    if row is not None and self.keeps(row):
                        rows.append(row)
                        if len(rows) == BATCH_ROWS:
                            yield self._batch(rows, kind)
                            rows = []
        if rows:
            yield self._batch(rows, kind)

    @staticmethod
    def _batch(rows: list[dict], kind: pa.Schema) -> pa.RecordBatch:
        def column(field: pa.Field) -> pa.Array:
            values = [r.get(field.name) for r in rows]
            if pa.types.is_temporal(field.type):  # ISO texts in the file
                return pa.array(values, pa.string()).cast(field.type)
            return pa.array(values, field.type)

        return pa.RecordBatch.from_arrays([column(f) for f in kind], schema=kind)


class JsonLinesWriter(DataSourceArrowWriter):
    """Tasks write staged files under hidden names; the commit renames them, an abort removes them."""

    def __init__(self, path: str, compression: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path, ".jsonl.gz" if compression == "gzip" else ".jsonl", overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder)
        staged, rows = f"{folder}/.staged-{uuid.uuid4().hex}{self.suffix}", 0
        with store.open_output_stream(staged) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write((json.dumps(row, ensure_ascii=False, default=lambda v: v.isoformat()) + "\n").encode("utf-8"))
                rows += len(batch)
        return Written(staged, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, old = _store(self.path)[0], _files(self.path) if self.overwrite else []
        for message in messages:
            if message is not None and message.rows:
                store.move(message.staged, message.staged.replace("/.staged-", "/part-"))
            elif message is not None:
                store.delete_file(message.staged)
        for path in old:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store = _store(self.path)[0]
        for message in messages:
            if message is not None:
                store.delete_file(message.staged)


class JsonLines(DataSource):
    """Options: ``path`` (a folder), and for writing ``compression`` (``none`` or ``gzip``). The schema is declared by the user."""

    @classmethod
    def name(cls) -> str:
        return "tablesync-jsonl"

    def schema(self) -> T.StructType:
        raise ValueError("declare the schema of a tablesync-jsonl table")

    def reader(self, schema: T.StructType) -> JsonLinesReader:
        return JsonLinesReader(schema, self.options["path"], json.loads(self.options.get("filters", "[]")))

    def writer(self, schema: T.StructType, overwrite: bool) -> JsonLinesWriter:
        return JsonLinesWriter(self.options["path"], self.options.get("compression", "none"), overwrite)


def register_data_source(spark: SparkSession, source: type[DataSource]) -> str:
    """Make a Python data source a format of the session; returns its name."""
    spark.dataSource.register(source)
    return source.name()


class PluginSource(Source):
    """Tables of a registered format. ``connect``: ``format`` (a name or a ``DataSource`` class), ``options``,
    ``root`` (tables are ``root/schema/table``), ``schemas`` (by table name)."""

    default_namespace = "plugin"

    @property
    def format(self) -> str:
        kind = self.connect["format"]
        return kind if isinstance(kind, str) else register_data_source(self.spark, kind)

    def table(self, spec: StreamSpec) -> DataFrame:
        reader = self.spark.read.format(self.format).options(**self.connect.get("options", {}))
        schema = self.connect.get("schemas", {}).get(spec.name)
        reader = reader.schema(schema) if schema is not None else reader
        path = "/".join(p for p in (self.connect.get("root", "").rstrip("/"), spec.schema_name, spec.name) if p)
        filters = [(name, "=", value) for name, value in spec.filters.items() if isinstance(value, (str, int, bool))]
        return reader.option("path", path).option("filters", json.dumps(filters)).load()

    def inspect(self) -> DataFrame:
        """The tables whose schemas are declared."""
        return inspect_schemas(self.spark, [("", name, self.table(StreamSpec(name)).schema) for name in self.connect.get("schemas", {})])
