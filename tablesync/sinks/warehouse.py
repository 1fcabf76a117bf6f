"""Warehouse sinks: a staged Parquet batch or a connector load, then the warehouse's own merge.

Only configuration and statements live here. The connectors and accounts are the
user's; ``runner`` takes the statements where Spark itself cannot run them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablesync.dataset import Dataset, Stream
from tablesync.errors import DestinationError, DestinationStreamInvalidSchema
from tablesync.functions.identifiers import derived_identifier, safe_identifier, with_safe_columns
from tablesync.functions.types import schemas_compatible
from tablesync.operators.upsert import prepare_stage, surplus_rows
from tablesync.sinks import statements as sql
from tablesync.sinks.base import Sink
from tablesync.sinks.jdbc import Runner, UpsertJdbcSink, portable
from tablesync.sinks.objectstore import ObjectStoreSink, bucket_root, staging_path
from tablesync.sources.warehouse import bigquery_options, snowflake_options


#: What warehouses say of a table that does not exist.
_ABSENT = re.compile("not found|does not exist|no such table", re.IGNORECASE)


class RedshiftSink(UpsertJdbcSink):
    """Loads the batch an S3 sink staged with COPY, then deletes and inserts by key.

    ``connect`` adds ``s3_bucket``, ``s3_prefix``, ``s3_region`` and ``iam_role``.
    """

    label, vendor, strategy = "redshift", "redshift", "delete_insert"

    def copy_uri(self, stream: Stream, dataset: Dataset) -> str:
        root = bucket_root("s3", self.connect["s3_bucket"], self.connect.get("s3_prefix"))
        if self.trial:
            root = f"{root}/trial-{dataset.ctx.batch_id}"
        return staging_path(root, dataset.namespace, stream.spec, dataset.ctx)

    def load_statements(self, stream: Stream, dataset: Dataset) -> list[str]:
        stage = f"stage_{stream.spec.folder}"
        uri = self.copy_uri(stream, dataset)
        return [
            sql.redshift_stage(stage, self.table_name(stream)),
            sql.redshift_copy(stage, uri, self.connect["iam_role"], self.connect.get("s3_region")),
            *self.merge_statements(stream, stage, with_safe_columns(stream.df).columns),
        ]

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        table = self.table_name(stream)
        if self.mode.incremental:
            self.ensure_table(portable(stream.df), table, stream.spec.keys)
            self.run(self.load_statements(stream, dataset))
            return
        # the new table is loaded beside the live one and takes its place in one transaction
        fresh = self.stage_name(stream, dataset)
        self.run([sql.drop(fresh)])
        try:
            self.ensure_table(portable(stream.df), fresh, [])
            copy = sql.redshift_copy(fresh, self.copy_uri(stream, dataset), self.connect["iam_role"], self.connect.get("s3_region"))
            self.run([copy, *sql.swap_in(fresh, table, stream.spec.keys, self.quote)])
        except Exception:
            self.run([sql.drop(fresh)])
            raise


class ConnectorSink(Sink):
    """Common part of sinks that load a stage table through a Spark connector and then merge."""

    format = ""
    quote = ""

    def __init__(self, spark, config=None, runner: Runner | None = None):
        super().__init__(spark, config)
        self.options = self.connector_options()
        self.runner = runner

    def connector_options(self) -> dict[str, str]:
        raise NotImplementedError

    def table_name(self, stream: Stream) -> str:
        name = safe_identifier(stream.spec.qualified_name)
        return derived_identifier(name, "__trial") if self.trial else name

    def stage_name(self, stream: Stream) -> str:
        return derived_identifier(stream.spec.qualified_name, "__stage")

    def rows(self, stream: Stream):
        spec = stream.spec
        cursor = spec.cursor_field if spec.cursor_field in stream.df.columns else None
        policy = self.connect.get("dedupe", "latest")
        return portable(prepare_stage(stream.df, spec.require_keys(), cursor, policy))

    def expected_rows(self, stream: Stream, staged: int) -> int | None:
        """Repeated keys are merged into one row each."""
        if self.connect.get("dedupe", "latest") == "none" or not staged:
            return staged
        return staged - surplus_rows(stream.df, stream.spec.require_keys(), stream.rows)

    def check_schema(self, stream: Stream, dataset: Dataset) -> None:
        """An increment must fit the table it is merged into."""
        existing = self.existing(stream) if self.mode.incremental and not self.trial else None
        if existing is not None and not schemas_compatible(portable(stream.df).schema, existing):
            raise DestinationStreamInvalidSchema(f"the existing schema of {self.table_name(stream)} does not match the stream")

    def read_table(self, stream: Stream) -> DataFrame:
        raise NotImplementedError

    def existing(self, stream: Stream) -> T.StructType | None:
        """Schema of the target, None if there is none, as before the first load; any other failure is one."""
        try:
            return self.read_table(stream).schema
        except Exception as cause:
            if _ABSENT.search(str(cause)):
                return None
            raise

    def target(self, stream: Stream, dataset: Dataset):
        return None if self.trial else self.read_table(stream)

    def merge_statements(self, stream: Stream) -> list[str]:
        """Create the target if absent and merge; a full refresh replaces it in one statement; the stage goes."""
        target, stage = self.table_name(stream), self.stage_name(stream)
        if self.mode.incremental:
            merge = sql.Merge(target, stage, with_safe_columns(stream.df).columns, stream.spec.require_keys(), self.quote).merge()
            load = [sql.empty_copy(target, stage), *merge]
        else:  # the stage holds each key once already
            load = [sql.replace_by(target, stage)]
        return [*load, sql.drop(stage), *([sql.drop(target)] if self.trial else [])]


class SnowflakeSink(ConnectorSink):
    """The connector stages, loads and then runs the merge as its post-actions."""

    label, format = "snowflake", "snowflake"

    def connector_options(self) -> dict[str, str]:
        return snowflake_options(self.connect)

    def write_options(self, stream: Stream) -> dict[str, str]:
        return {
            **self.options,
            "dbtable": self.stage_name(stream),
            "usestagingtable": "off",
            "postactions": "; ".join(self.merge_statements(stream)),
        }

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        self.check_schema(stream, dataset)
        self.rows(stream).write.format("snowflake").options(**self.write_options(stream)).mode("overwrite").save()

    def read_table(self, stream: Stream) -> DataFrame:
        return self.spark.read.format("snowflake").options(**self.options, dbtable=self.table_name(stream)).load()


class BigQuerySink(ConnectorSink):
    """The connector writes the stage table; ``runner`` submits the merge as a query job."""

    label, format, quote = "bigquery", "bigquery", "`"

    def connector_options(self) -> dict[str, str]:
        return bigquery_options(self.connect)

    def write_options(self, stream: Stream) -> dict[str, str]:
        table = f"{self.connect['project_id']}.{self.stage_name(stream)}"
        out = {**self.options, "table": table}
        if self.connect.get("gcs_bucket_name"):
            bucket = bucket_root("gs", self.connect["gcs_bucket_name"]).removeprefix("gs://")
            return {**out, "writeMethod": "indirect", "temporaryGcsBucket": bucket}
        return {**out, "writeMethod": "direct"}

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        if self.runner is None:
            raise DestinationError("destination-bigquery needs a runner for its merge statements")
        self.check_schema(stream, dataset)
        self.rows(stream).write.format("bigquery").options(**self.write_options(stream)).mode("overwrite").save()
        self.runner(self.merge_statements(stream))

    def read_table(self, stream: Stream) -> DataFrame:
        table = f"{self.connect['project_id']}.{self.table_name(stream)}"
        return self.spark.read.format("bigquery").options(**self.options, table=table).load()


class SnowflakeStageSink(ObjectStoreSink):
    """Parquet into the external stage location Snowflake reads from (``root``); staging layout only."""

    label = "snowflake-stage"

    def __init__(self, spark, config=None):
        super().__init__(spark, config)
        if self.format != "staging":
            raise DestinationError(f"format {self.format} is not supported by a Snowflake stage")

    def copy_statement(self, stream: Stream, dataset: Dataset, table: str) -> str:
        """COPY of exactly this batch folder, so that tables with a common name prefix stay apart."""
        folder = self.path(stream, dataset).removeprefix(self.root.rstrip("/")).strip("/")
        stage = self.connect.get("stage_name", f"sync_{dataset.ctx.batch_id}")
        return (
            f"COPY INTO {table} FROM @{stage}/{folder}/ FILE_FORMAT = (TYPE = PARQUET) "
            f"MATCH_BY_COLUMN_NAME = CASE_INSENSITIVE"
        )
