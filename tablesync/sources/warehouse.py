"""Warehouses read through their Spark connectors; this module only maps configuration to options.

The connectors are separate packages. Spark pushes filters and projection into them as
into any other source.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from tablesync.functions.identifiers import safe_identifier
from tablesync.sources.base import Source, inspect_columns
from tablesync.sources.jdbc import require_auth
from tablesync.spec import StreamSpec


def _required(connect: Mapping[str, Any], names: tuple[str, ...], vendor: str) -> None:
    for name in names:
        if not connect.get(name):
            raise ValueError(f"{vendor} connection config must include {name!r}")


def snowflake_options(connect: Mapping[str, Any]) -> dict[str, str]:
    """Options of the ``snowflake`` format; the access token stands in for the password."""
    require_auth(connect, "access_token", "snowflake")
    _required(connect, ("user", "access_token", "account", "database", "warehouse"), "snowflake")
    return {
        "sfURL": f"{connect['account']}.snowflakecomputing.com",
        "sfUser": connect["user"],
        "sfPassword": connect["access_token"],
        "sfDatabase": connect["database"],
        "sfSchema": connect.get("target_schema") or connect.get("schema") or "public",
        "sfWarehouse": connect["warehouse"],
    }


def bigquery_options(connect: Mapping[str, Any]) -> dict[str, str]:
    """Options of the ``bigquery`` format; the service account JSON travels base64 encoded."""
    require_auth(connect, "service_account", "bigquery")
    _required(connect, ("project_id", "service_account"), "bigquery")
    try:
        json.loads(connect["service_account"])
    except json.JSONDecodeError as cause:
        raise ValueError(f"service account is not valid JSON: {cause}") from cause
    encoded = base64.b64encode(connect["service_account"].encode()).decode()
    return {"parentProject": connect["project_id"], "credentials": encoded}


class SnowflakeSource(Source):
    """Tables of a Snowflake database."""

    def __init__(self, spark, config=None):
        super().__init__(spark, config)
        self.options = snowflake_options(self.connect)

    @property
    def namespace(self) -> str:
        return self.connect["database"]

    def _load(self, **extra: str) -> DataFrame:
        return self.spark.read.format("snowflake").options(**self.options, **extra).load()

    def table(self, spec: StreamSpec) -> DataFrame:
        if spec.query:
            return self._load(query=spec.query)
        return self._load(dbtable=safe_identifier(spec.qualified_name))

    def raw(self, spec: StreamSpec) -> DataFrame:
        return self.table(spec)

    def probe(self) -> None:
        self._load(query="select 1 as one").first()

    def inspect(self) -> DataFrame:
        columns = self._load(dbtable="information_schema.columns")
        return inspect_columns(columns.toDF(*[c.lower() for c in columns.columns]))


class BigQuerySource(Source):
    """Tables of a BigQuery project."""

    def __init__(self, spark, config=None):
        super().__init__(spark, config)
        self.options = bigquery_options(self.connect)

    @property
    def namespace(self) -> str:
        return self.connect["project_id"]

    def table_name(self, spec: StreamSpec) -> str:
        return f"{self.connect['project_id']}.{spec.qualified_name}"

    def _query(self, text: str) -> DataFrame:
        # query results need a dataset the connector may materialise into
        extra = {"viewsEnabled": "true", "query": text}
        if self.connect.get("dataset"):
            extra["materializationDataset"] = self.connect["dataset"]
        return self.spark.read.format("bigquery").options(**self.options, **extra).load()

    def table(self, spec: StreamSpec) -> DataFrame:
        if spec.query:
            return self._query(spec.query)
        return self.spark.read.format("bigquery").options(**self.options, table=self.table_name(spec)).load()

    def raw(self, spec: StreamSpec) -> DataFrame:
        return self.table(spec)

    def probe(self) -> None:
        self._query("select 1 as one").first()

    def inspect(self) -> DataFrame:
        region = self.connect.get("region", "region-us")
        names = "table_schema, table_name, column_name, data_type, ordinal_position"
        return inspect_columns(self._query(f"select {names} from `{region}`.INFORMATION_SCHEMA.COLUMNS"))
