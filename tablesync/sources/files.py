"""Tables in files (Parquet, ORC, JSON, CSV) and tables of the Spark catalog."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablesync.errors import SourceConnectionFailed
from tablesync.sources.base import SYSTEM_SCHEMAS, Source, inspect_schemas
from tablesync.spec import StreamSpec
from tablesync.workspace import Folder


class FileSource(Source):
    """``connect``: ``root`` folder, ``format`` (default parquet), reader ``options``, ``suffix``.

    A table is ``root[/schema]/table`` plus the suffix; without a suffix both
    ``table`` and ``table.<format>`` are found.
    """

    default_namespace = "files"

    @property
    def format(self) -> str:
        return self.connect.get("format", "parquet")

    def _folder(self, schema_name: str) -> str:
        root = self.connect["root"].rstrip("/")
        return f"{root}/{schema_name}" if schema_name else root

    def table(self, spec: StreamSpec) -> DataFrame:
        folder = Folder(self.spark, self._folder(spec.schema_name))
        suffix = self.connect.get("suffix", f".{self.format}")
        name = spec.name + suffix if folder.exists(spec.name + suffix) else spec.name
        reader = self.spark.read.format(self.format).options(**self.connect.get("options", {}))
        schema = self.connect.get("schemas", {}).get(spec.name)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(f"{folder.path}/{name}")

    def probe(self) -> None:
        if not Folder(self.spark, self.connect["root"]).exists():
            raise SourceConnectionFailed(f"no such folder: {self.connect['root']}")

    def _tables(self, schema_name: str) -> tuple[list[tuple[str, str, T.StructType]], list[str]]:
        """Readable tables of one folder, and the names that are no tables of this format."""
        suffix = self.connect.get("suffix", f".{self.format}")
        found, others = [], []
        for name in Folder(self.spark, self._folder(schema_name)).names():
            if name[0] in "._":
                continue
            spec = StreamSpec(name.removesuffix(suffix), schema_name)
            try:
                found.append((schema_name, spec.name, self.table(spec).schema))
            except (PySparkException, Py4JJavaError):
                others.append(name)
        return found, others

    def inspect(self) -> DataFrame:
        """Tables below the root and, one level down, below schema folders."""
        found, others = self._tables("")
        for folder in others:
            found += self._tables(folder)[0]
        return inspect_schemas(self.spark, found)


class CatalogSource(Source):
    """Tables and views of the session catalog, as ``schema.table``."""

    default_namespace = "spark_catalog"

    def table(self, spec: StreamSpec) -> DataFrame:
        return self.spark.table(spec.qualified_name)

    def inspect(self) -> DataFrame:
        found = []
        for db in self.spark.catalog.listDatabases():
            if db.name in SYSTEM_SCHEMAS:
                continue
            for t in self.spark.catalog.listTables(db.name):
                if not t.isTemporary:
                    found.append((db.name, t.name, self.spark.table(f"`{db.name}`.`{t.name}`").schema))
        return inspect_schemas(self.spark, found)
