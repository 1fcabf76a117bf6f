"""Database sinks over JDBC: parallel batch inserts, then one set-based merge on the server."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tablesync.dataset import Dataset, Stream
from tablesync.errors import DestinationConnectionFailed, DestinationError, DestinationStreamInvalidSchema
from tablesync.functions.identifiers import derived_identifier, safe_identifier, with_safe_columns
from tablesync.functions.types import normalise, schemas_compatible
from tablesync.operators.upsert import prepare_stage, surplus_rows
from tablesync.sinks import statements as sql
from tablesync.sinks.base import Sink
from tablesync.sources.jdbc import jdbc_options, require_auth

DEFAULT_BATCH = 1024
DEFAULT_WRITERS = 16

#: Runs statements in one transaction.
Runner = Callable[[Sequence[str]], None]


def driver_runner(spark: SparkSession, options: Mapping[str, str]) -> Runner:
    """Run statements over one JDBC connection of the driver; all succeed or none."""
    def run(commands: Sequence[str]) -> None:
        jvm = spark.sparkContext._jvm
        if options.get("driver"):
            jvm.java.lang.Class.forName(options["driver"])
        properties = jvm.java.util.Properties()
        for name in ("user", "password"):
            if options.get(name):
                properties.setProperty(name, options[name])
        connection = jvm.java.sql.DriverManager.getConnection(options["url"], properties)
        try:
            connection.setAutoCommit(False)
            for command in commands:
                statement = connection.createStatement()
                statement.execute(command)
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    return run


def portable(df: DataFrame) -> DataFrame:
    """Column names and types every database has: nested values as JSON text, decimals as doubles."""
    return normalise(with_safe_columns(df), decimals="double", nested="json")


class JdbcSink(Sink):
    """Full refresh of database tables: load a stage table, then swap it in; readers see the old rows or the new.

    ``connect``: ``url`` or host/port/database, ``user``, ``password``, ``chunk_size``
    (rows per insert batch), ``writers`` (parallel connections).
    """

    label = "sql"
    vendor: str | None = None
    strategy: str | None = None
    checkable = True
    quote = '"'  # Spark's JDBC writer creates columns quoted, too

    def __init__(self, spark, config=None, runner: Runner | None = None):
        super().__init__(spark, config)
        require_auth(self.connect, "basic", self.vendor or "sql")
        self._runner = runner

    @property
    def options(self) -> dict[str, str]:
        return jdbc_options(self.connect, self.vendor)

    @property
    def run(self) -> Runner:
        return self._runner or driver_runner(self.spark, self.options)

    def table_name(self, stream: Stream) -> str:
        name = safe_identifier(stream.spec.qualified_name)
        return derived_identifier(name, "__trial") if self.trial else name

    def stage_name(self, stream: Stream, dataset: Dataset) -> str:
        return derived_identifier(self.table_name(stream), f"__stage_{safe_identifier('b' + dataset.ctx.batch_id)}")

    # ---- the three accesses to the database, separate so that a test can replace them

    def load(self, table: str) -> DataFrame | None:
        """The table as it is, None if it does not exist."""
        try:
            return self.spark.read.format("jdbc").options(**self.options, dbtable=table).load()
        except Exception:
            try:
                self.run(["select 1"])
            except Exception as cause:
                raise DestinationConnectionFailed(f"cannot reach {self.options['url']}: {cause}") from cause
            return None

    def insert(self, df: DataFrame, table: str, mode: str) -> None:
        writers = str(self.connect.get("writers", DEFAULT_WRITERS))
        batch = str(self.connect.get("chunk_size", DEFAULT_BATCH))
        writer = df.write.format("jdbc").mode(mode).options(**self.options, dbtable=table)
        writer.option("truncate", "true").option("batchsize", batch).option("numPartitions", writers).save()

    # ----

    def ensure_table(self, df: DataFrame, table: str, keys: Sequence[str]) -> None:
        """Create the target with its primary key, or check that the existing one fits."""
        existing = self.load(table)
        if existing is None:
            # not "overwrite": a table that merely could not be read must not be truncated
            self.insert(df.limit(0), table, "errorifexists")
            if keys:
                self.run([sql.add_primary_key(table, keys, self.quote)])
        elif not schemas_compatible(df.schema, existing.schema):
            raise DestinationStreamInvalidSchema(f"the existing schema of {table} does not match the stream")

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        if self.mode.incremental:
            raise DestinationError(f"{type(self).__name__} only supports full refreshes")
        self.refresh(portable(stream.df), stream, dataset, [])

    def refresh(self, df: DataFrame, stream: Stream, dataset: Dataset, keys: Sequence[str]) -> None:
        table, stage = self.table_name(stream), self.stage_name(stream, dataset)
        try:
            self.insert(df, stage, "overwrite")
            self.run(sql.swap_in(stage, table, keys, self.quote))
        except Exception:
            self.run([sql.drop(stage)])
            raise

    def loaded_rows(self, stream: Stream, dataset: Dataset, target: DataFrame) -> int:
        """Counted by the database, which returns one row."""
        query = sql.count_where(self.table_name(stream), dataset.ctx.column("batch_id"), dataset.ctx.batch_id, self.quote)
        return int(self.ask(query).first()[0])

    def ask(self, query: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options, query=query).load()

    def target(self, stream: Stream, dataset: Dataset) -> DataFrame | None:
        return self.load(self.table_name(stream))

    def finish(self, stream: Stream, dataset: Dataset) -> None:
        self.run([sql.drop(self.table_name(stream))])


class UpsertJdbcSink(JdbcSink):
    """Upsert by primary key with a stage table; the strategy is the vendor's merge statement.

    Repeated keys are resolved in Spark, where the newest row of a key wins.
    """

    strategy = "merge"

    def stage_rows(self, stream: Stream) -> DataFrame:
        spec = stream.spec
        policy = self.connect.get("dedupe", "none" if self.strategy == "delete_insert" else "latest")
        cursor = spec.cursor_field if spec.cursor_field in stream.df.columns else None
        return portable(prepare_stage(stream.df, spec.require_keys(), cursor, policy))

    def merge_statements(self, stream: Stream, stage: str, columns: Sequence[str]) -> list[str]:
        merge = sql.Merge(self.table_name(stream), stage, columns, stream.spec.require_keys(), self.quote)
        return [*merge.statements(self.strategy), sql.drop(stage)]

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        df, table = self.stage_rows(stream), self.table_name(stream)
        if not self.mode.incremental:
            self.refresh(df, stream, dataset, stream.spec.require_keys())
            return
        stage = self.stage_name(stream, dataset)
        self.ensure_table(df, table, stream.spec.keys)
        try:
            self.insert(df, stage, "overwrite")
            self.run(self.merge_statements(stream, stage, df.columns))
        except Exception:
            self.run([sql.drop(stage)])
            raise

    def expected_rows(self, stream: Stream, staged: int) -> int | None:
        if self.connect.get("dedupe", "latest") == "none" or self.strategy == "delete_insert":
            return staged
        return staged - surplus_rows(stream.df, stream.spec.keys) if staged else 0


class PostgresSink(UpsertJdbcSink):
    label, vendor, strategy = "postgresql", "postgresql", "on_conflict"
