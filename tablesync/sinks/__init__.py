"""Sinks by connector name and by vendor."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession

from tablesync.sinks.base import Sink
from tablesync.sinks.catalog import CatalogSink
from tablesync.sinks.compound import CompoundSink, multi_sink
from tablesync.sinks.console import ConsoleSink
from tablesync.sinks.jdbc import JdbcSink, PostgresSink
from tablesync.sinks.objectstore import AbsSink, GcsSink, ObjectStoreSink, S3Sink
from tablesync.sinks.snapshot import SnapshotSink
from tablesync.sinks.warehouse import BigQuerySink, RedshiftSink, SnowflakeSink, SnowflakeStageSink


def _glue_on_s3(spark, config=None) -> CompoundSink:
    store = S3Sink(spark, config)
    connect = {**(config or {}).get("connect", {}), "store": store}
    return CompoundSink(spark, config, [store, CatalogSink(spark, {**(config or {}), "connect": connect})])


# Connector names and the vendor names that select them.
SINKS: dict[str, Callable[..., Sink]] = {
    "destination-sql": JdbcSink,
    "destination-glue": CatalogSink,
    "destination-stdout": ConsoleSink,
    "destination-redshift": RedshiftSink,
    "destination-bigquery": BigQuerySink,
    "destination-s3": S3Sink,
    "destination-gcs": GcsSink,
    "destination-abs": AbsSink,
    "destination-snowflake-storage": SnowflakeStageSink,
    "destination-snowflake": SnowflakeSink,
    "destination-postgres": PostgresSink,
    "destination-redshift-s3": multi_sink(S3Sink, RedshiftSink),
    "destination-glue-s3": _glue_on_s3,
    "destination-bigquery-gcs": BigQuerySink,
    "destination-snowflake-sms": SnowflakeSink,
    "destination-files": ObjectStoreSink,
    "destination-snapshot": SnapshotSink,
}

VENDOR_SINKS = {
    "console": "destination-stdout",
    "redshift": "destination-redshift-s3",
    "snowflake": "destination-snowflake-sms",
    "bigquery": "destination-bigquery-gcs",
    "glue": "destination-glue-s3",
    "s3": "destination-s3",
    "gcs": "destination-gcs",
    "abs": "destination-abs",
    "postgresql": "destination-postgres",
    "files": "destination-files",
    "snapshot": "destination-snapshot",
}


def register_sink(name: str, sink: Callable[..., Sink], vendor: str | None = None) -> None:
    """Add a connector of your own."""
    SINKS[name] = sink
    if vendor:
        VENDOR_SINKS[vendor] = name


def get_destination(spark: SparkSession, name: str, config: Mapping[str, Any] | None = None) -> Sink:
    return SINKS[name](spark, config)


def get_destination_by_vendor(vendor: str) -> str:
    return VENDOR_SINKS[vendor]
