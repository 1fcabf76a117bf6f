"""Database tables over JDBC, read in parallel slices."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablesync.errors import SourceStreamDoesNotExist, SyncError
from tablesync.functions.identifiers import safe_identifier
from tablesync.operators.extract import validate
from tablesync.sources.base import Source, inspect_columns
from tablesync.spec import Mode, StreamSpec

# Driver class and URL scheme per vendor, and an even hash of a key column in its SQL.
VENDORS = {
    "postgresql": ("org.postgresql.Driver", "postgresql", 5432, "mod(abs(hashtext(cast({c} as text))::bigint), {n})"),
    "redshift": ("com.amazon.redshift.Driver", "redshift", 5439, "mod(abs(checksum({c})), {n})"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "mysql", 3306, "mod(crc32({c}), {n})"),
}

DEFAULT_FETCH = 1024
DEFAULT_SLICES = 16

_RANGE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def require_auth(connect: Mapping[str, Any], kind: str, vendor: str) -> None:
    if connect.get("auth_type") != kind:
        raise ValueError(f"{vendor} only supports {kind!r} authentication, got {connect.get('auth_type')!r}")


def jdbc_url(connect: Mapping[str, Any], vendor: str | None = None) -> str:
    """The configured ``url``, or one built from host, port and database."""
    if connect.get("url"):
        return connect["url"]
    if vendor not in VENDORS:
        raise ValueError("connect needs a JDBC 'url'")
    if not connect.get("database"):
        raise ValueError(f"{vendor} connection config must include 'database'")
    _, scheme, port, _ = VENDORS[vendor]
    return f"jdbc:{scheme}://{connect.get('host')}:{connect.get('port', port)}/{connect['database']}"


def jdbc_options(connect: Mapping[str, Any], vendor: str | None = None) -> dict[str, str]:
    """Connection options shared by reads and writes."""
    out = {"url": jdbc_url(connect, vendor)}
    driver = connect.get("driver") or (VENDORS[vendor][0] if vendor in VENDORS else None)
    for name, value in (("user", connect.get("user")), ("password", connect.get("password")), ("driver", driver)):
        if value:
            out[name] = str(value)
    return out


def range_split(column: str, lower: Any, upper: Any, slices: int) -> dict[str, str]:
    """Options that cut a read into ranges of a column; the bounds only set the stride."""
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(slices),
    }


def hash_predicates(column: str, slices: int, vendor: str) -> list[str]:
    """One WHERE clause per slice over an even hash of a (unique) key, for keys without a range."""
    if vendor not in VENDORS:
        raise ValueError(f"no hash expression known for {vendor}")
    expression = VENDORS[vendor][3].format(c=safe_identifier(column), n=int(slices))
    clauses = [f"{expression} = {i}" for i in range(int(slices))]
    clauses[0] += f" or {safe_identifier(column)} is null"
    return clauses


class UnsplitRead(UserWarning):
    """A whole table or query goes through one connection."""


def snapshot_options(vendor: str | None, snapshot: str | None) -> dict[str, str]:
    """Options that open every connection of a read in one exported snapshot of the database."""
    if snapshot is None:
        return {}
    if vendor != "postgresql":
        raise ValueError(f"{vendor} has no exported snapshots")
    if not re.fullmatch("[0-9A-Fa-f-]+", snapshot):
        raise ValueError(f"no snapshot id: {snapshot!r}")
    return {"sessionInitStatement": f"SET TRANSACTION ISOLATION LEVEL REPEATABLE READ; SET TRANSACTION SNAPSHOT '{snapshot}'"}


class JdbcSource(Source):
    """Any database with a JDBC driver: ``connect`` holds ``url`` or host/port/database, user, password.

    ``chunk_size`` is the fetch size, ``slices`` the number of parallel reads; ``partition_column`` (a number, date or
    time) or ``predicates`` (one clause per slice), for all streams or by stream, say how to slice queries and text keys. The window,
    tenant filter and projection are pushed into the database by Spark. ``exported_snapshot`` (PostgreSQL) is the id of a snapshot that
    another session exported and keeps open: all slices, and the counts beside them, then see the same rows.
    """

    vendor: str | None = None
    auth: str | None = None

    def __init__(self, spark, config=None):
        super().__init__(spark, config)
        if self.auth:
            require_auth(self.connect, self.auth, self.vendor)

    @property
    def namespace(self) -> str:
        return self.connect.get("namespace") or self.connect.get("database") or self.default_namespace

    def options(self) -> dict[str, str]:
        fetch = str(self.connect.get("chunk_size", DEFAULT_FETCH))
        shared = snapshot_options(self.vendor, self.connect.get("exported_snapshot"))
        return {**jdbc_options(self.connect, self.vendor), "fetchsize": fetch, **shared}

    def table_name(self, spec: StreamSpec) -> str:
        return safe_identifier(spec.qualified_name)

    def split(self, spec: StreamSpec, schema: T.StructType, mode: Mode) -> dict[str, str]:
        """Range options: the window of an incremental run, else min and max of the key."""
        slices = int(self.connect.get("slices", DEFAULT_SLICES))
        cursor = spec.cursor_field
        if mode.incremental and isinstance(schema[cursor].dataType, (T.TimestampType, T.TimestampNTZType)):
            lower, upper = (m.strftime("%Y-%m-%d %H:%M:%S.%f") for m in (mode.start, mode.end))
            return range_split(cursor, lower, upper, slices)
        if len(spec.keys) == 1 and isinstance(schema[spec.keys[0]].dataType, _RANGE_TYPES):
            return self.bounds_split(spec, spec.keys[0], slices)
        return {}

    def _load(self, extra: Mapping[str, str]) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options(), **extra).load()

    def relation(self, spec: StreamSpec) -> str:
        """What is read: the table, or the declared query in brackets."""
        return f"({spec.query}) q" if spec.query else self.table_name(spec)

    def _for_stream(self, name: str, spec: StreamSpec) -> Any:
        """A setting for all streams, or by stream name."""
        value = self.connect.get(name)
        return value.get(spec.name, value.get(spec.qualified_name)) if isinstance(value, Mapping) else value

    def _by_predicates(self, spec: StreamSpec, predicates: Sequence[str]) -> DataFrame:
        options = self.options()
        return self.spark.read.jdbc(options.pop("url"), self.relation(spec), predicates=list(predicates), properties=options)

    def table(self, spec: StreamSpec) -> DataFrame:
        """The table or query, read in slices: by the caller's ``predicates`` or ``partition_column``, else as :meth:`split` finds."""
        source = {"dbtable": self.relation(spec)}
        slices = int(self.connect.get("slices", DEFAULT_SLICES))
        df = self._load(source)
        if slices <= 1:
            return df
        predicates, chosen = self._for_stream("predicates", spec), self._for_stream("partition_column", spec)
        if predicates:
            return self._by_predicates(spec, predicates)
        validate(df.schema, spec, self.mode)
        split = self.bounds_split(spec, chosen, slices) if chosen else self.split(spec, df.schema, self.mode)
        if split:
            return self._load({**source, **split})
        if not chosen and len(spec.keys) == 1 and self.vendor in VENDORS:
            return self._by_predicates(spec, hash_predicates(spec.keys[0], slices, self.vendor))
        if not chosen:
            warnings.warn(
                f"{spec.qualified_name} is read by one task: give a partition_column or predicates", UnsplitRead, stacklevel=2
            )
        return df

    def bounds_split(self, spec: StreamSpec, name: str, slices: int) -> dict[str, str]:
        """Range options by a column whose bounds the database aggregates; one row travels."""
        key = safe_identifier(name)
        low, high = self._load({"query": f"select min({key}) as lo, max({key}) as hi from {self.relation(spec)}"}).first()
        return range_split(name, low, high, slices) if low is not None and low != high else {}

    def raw(self, spec: StreamSpec) -> DataFrame:
        try:
            return self.table(spec)
        except (AnalysisException, SyncError):
            raise
        except Exception as cause:
            self.test_connect()  # raises if the database is the problem, not the table
            raise SourceStreamDoesNotExist(f"no such table: {spec.qualified_name}") from cause

    def probe(self) -> None:
        self._load({"query": "select 1 as one"}).first()

    def inspect(self) -> DataFrame:
        names = "table_schema, table_name, column_name, data_type, ordinal_position"
        columns = self._load({"query": f"select {names} from information_schema.columns"})
        return inspect_columns(columns.toDF(*[c.lower() for c in columns.columns]))


class PostgresSource(JdbcSource):
    vendor, auth = "postgresql", "basic"


class RedshiftSource(JdbcSource):
    vendor, auth = "redshift", "basic"
