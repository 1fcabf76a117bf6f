"""Register written folders as tables of the Spark catalog (Hive, Glue or in-memory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablesync.dataset import Dataset, Stream
from tablesync.errors import DestinationError
from tablesync.sinks.base import Sink
from tablesync.sinks.objectstore import ObjectStoreSink


def register_table(spark: SparkSession, name: str, path: str, partitioned: bool = False) -> DataFrame:
    """Point the table ``name`` at a Parquet folder, replacing an older registration.

    Registering never touches data; a table that owns its data is not replaced. With
    ``partitioned`` the folders below the path are picked up as partitions.
    """
    parts = [f"`{p}`" for p in name.split(".")]
    if len(parts) > 1:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {'.'.join(parts[:-1])}")
    quoted = ".".join(parts)
    if spark.catalog.tableExists(quoted):
        if spark.catalog.getTable(quoted).tableType != "EXTERNAL":
            raise DestinationError(f"{name} is not an external table")
        spark.sql(f"DROP TABLE {quoted}")
    spark.catalog.createTable(quoted, path=path, source="parquet")
    if partitioned:
        spark.catalog.recoverPartitions(quoted)
    spark.catalog.refreshTable(quoted)
    return spark.table(quoted)


class CatalogSink(Sink):
    """Registers what an object-store sink with the same ``connect`` wrote, as ``database.table``."""

    label = "catalog"

    def __init__(self, spark, config=None):
        super().__init__(spark, config)
        self.store = self.connect.get("store") or ObjectStoreSink(spark, config)

    def table_name(self, stream: Stream) -> str:
        database = self.connect.get("database", "default")
        return f"{database}.{stream.spec.folder}"

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        path = self.store.path(stream, dataset)
        register_table(self.spark, self.table_name(stream), path, self.store.format == "hive")

    def target(self, stream: Stream, dataset: Dataset) -> DataFrame | None:
        name = self.table_name(stream)
        return self.spark.table(name) if self.spark.catalog.tableExists(name) else None

    def finish(self, stream: Stream, dataset: Dataset) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table_name(stream)}")
