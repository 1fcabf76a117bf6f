"""The source contract: a table by name, as a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.dataset import Dataset, Stream
from tablesync.errors import SourceConnectionFailed, SourceStreamDoesNotExist
from tablesync.functions.types import normalise
from tablesync.operators.augment import augment
from tablesync.operators.extract import extract
from tablesync.spec import Bookkeeping, Mode, StreamSpec, SyncContext

INSPECTION = T.StructType(
    [
        T.StructField("schema_name", T.StringType()),
        T.StructField("stream_name", T.StringType()),
        T.StructField(
            "fields",
            T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])),
        ),
    ]
)

# Schemas an inspection never shows.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "sys", "sqlite_master")


class Source:
    """A place tables are read from.

    ``config`` may hold ``connect`` (where and how), ``mode``, ``streams`` (one dict per
    table), ``with`` (bookkeeping columns), ``extra`` (constant or computed columns, see
    :func:`tablesync.operators.augment.augment`), ``dt`` (time of the run) and ``types``
    (options of :func:`tablesync.functions.types.normalise`). Subclasses implement
    :meth:`table` and :meth:`inspect`.
    """

    default_namespace = "default"

    def __init__(self, spark: SparkSession, config: Mapping[str, Any] | None = None):
        self.spark = spark
        self.config = dict(config or {})
        self.connect = dict(self.config.get("connect") or {})
        self.mode = Mode.coerce(self.config.get("mode"))
        self.ctx = self.config.get("context") or SyncContext.at(self.config.get("dt"))
        self.marks = Bookkeeping.from_config(self.config.get("with"))

    @property
    def namespace(self) -> str:
        return self.connect.get("namespace") or self.default_namespace

    @property
    def specs(self) -> list[StreamSpec]:
        return [
            s if isinstance(s, StreamSpec) else StreamSpec.from_config(s, self.namespace)
            for s in self.config.get("streams") or []
        ]

    def table(self, spec: StreamSpec) -> DataFrame:
        """The unfiltered table of a stream; raises ``AnalysisException`` if absent."""
        raise NotImplementedError

    def inspect(self) -> DataFrame:
        """Available streams: ``schema_name, stream_name, fields array<struct<name, type>>``."""
        raise NotImplementedError

    def probe(self) -> None:
        """Touch the source; any exception means it cannot be reached."""

    def test_connect(self) -> bool:
        try:
            self.probe()
        except Exception as cause:
            raise SourceConnectionFailed(f"cannot reach {type(self).__name__}: {cause}") from cause
        return True

    def raw(self, spec: StreamSpec) -> DataFrame:
        """The table, or the declared query over it, with the error type of this package."""
        try:
            return self.spark.sql(spec.query) if spec.query else self.table(spec)
        except AnalysisException as cause:
            raise SourceStreamDoesNotExist(f"no such table: {spec.qualified_name}") from cause

    def stream(self, spec: StreamSpec) -> Stream:
        """One stream as a lazy plan: predicates, projection, bookkeeping, type normalisation."""
        rows = extract(self.raw(spec), spec, self.mode)
        shaped = augment(rows, self.ctx, self.marks, spec.drop_fields, self.config.get("extra"))
        return Stream(spec, normalise(shaped, **self.config.get("types", {})))

    def read(self) -> Dataset:
        """All configured streams; nothing runs until a sink writes them."""
        streams = tuple(self.stream(s) for s in self.specs)
        return Dataset(self.namespace, streams, self.ctx, self.mode)

    def counts(self) -> DataFrame:
        """``count(1)`` of every configured stream under its own predicates, in one job."""
        out = None
        for s in self.specs:
            one = extract(self.raw(s), s, self.mode).agg(F.count(F.lit(1)).alias("n"))
            one = one.select(F.lit(s.qualified_name).alias("stream"), "n")
            out = one if out is None else out.unionByName(one)
        return out


def inspect_columns(columns: DataFrame, ignore: tuple[str, ...] = SYSTEM_SCHEMAS) -> DataFrame:
    """Inspection from an ``information_schema.columns`` shaped DataFrame.

    Expects ``table_schema, table_name, column_name, data_type, ordinal_position``.
    Qualified table names (``project.dataset.table``) are cut to their last part.
    """
    named = columns.where(~F.lower("table_schema").isin(*ignore))
    field = F.struct("ordinal_position", F.col("column_name").alias("name"), F.col("data_type").alias("type"))
    return (
        named.groupBy(
            F.col("table_schema").alias("schema_name"),
            F.substring_index("table_name", ".", -1).alias("stream_name"),
        )
        .agg(F.array_sort(F.collect_list(field)).alias("fields"))
        .withColumn("fields", F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type"))))
    )


def inspect_schemas(spark: SparkSession, tables: list[tuple[str, str, T.StructType]]) -> DataFrame:
    """Inspection from schemas the driver already knows."""
    rows = [(s, t, [(f.name, f.dataType.simpleString()) for f in schema.fields]) for s, t, schema in tables]
    return spark.createDataFrame(rows, INSPECTION)
