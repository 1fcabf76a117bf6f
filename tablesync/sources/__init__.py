"""Sources by connector name and by vendor."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from tablesync.sources.base import Source
from tablesync.sources.datasource import PluginSource
from tablesync.sources.files import CatalogSource, FileSource
from tablesync.sources.fixture import FixtureSource
from tablesync.sources.jdbc import JdbcSource, PostgresSource, RedshiftSource
from tablesync.sources.warehouse import BigQuerySource, SnowflakeSource

# Connector names and the vendor names that select them.
SOURCES: dict[str, type[Source]] = {
    "source-sql": JdbcSource,
    "source-postgresql": PostgresSource,
    "source-redshift": RedshiftSource,
    "source-bigquery": BigQuerySource,
    "source-snowflake": SnowflakeSource,
    "source-memory": FixtureSource,
    "source-files": FileSource,
    "source-catalog": CatalogSource,
    "source-plugin": PluginSource,
}

VENDOR_SOURCES = {
    "memory": "source-memory",
    "redshift": "source-redshift",
    "snowflake": "source-snowflake",
    "bigquery": "source-bigquery",
    "postgresql": "source-postgresql",
    "mysql": "source-sql",
    "athena": "source-sql",
    "files": "source-files",
    "catalog": "source-catalog",
    "plugin": "source-plugin",
}


def register_source(name: str, source: type[Source], vendor: str | None = None) -> None:
    """Add a connector of your own."""
    SOURCES[name] = source
    if vendor:
        VENDOR_SOURCES[vendor] = name


def get_source(spark: SparkSession, name: str, config: Mapping[str, Any] | None = None) -> Source:
    return SOURCES[name](spark, config)


def get_source_by_vendor(vendor: str) -> str:
    return VENDOR_SOURCES[vendor]
