"""Reading side of a stream: predicates, projection, counts and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.errors import SourceStreamInvalidSchema, StreamError, StreamMissingField
from tablesync.functions.moments import typed_literal
from tablesync.spec import Mode, StreamSpec


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def _need(schema: T.StructType, spec: StreamSpec, name: str) -> T.DataType:
    if name not in schema.names:
        raise StreamMissingField(f"stream {spec.qualified_name} does not have field {name}")
    return schema[name].dataType


def validate(schema: T.StructType, spec: StreamSpec, mode: Mode | None = None) -> None:
    """Check every declared column against the source schema, before any job runs."""
    try:
        for name in [*spec.keys, *filter(None, [spec.cursor_field]), *spec.filters]:
            _need(schema, spec, name)
    except StreamMissingField as missing:
        raise SourceStreamInvalidSchema(str(missing)) from missing
    for name in [*spec.drop_fields, *spec.include_columns]:
        _need(schema, spec, name)
    if mode is not None and mode.incremental and not spec.cursor_field:
        raise StreamError(f"stream {spec.qualified_name} needs a cursor field for an incremental run")


def window_predicate(schema: T.StructType, spec: StreamSpec, mode: Mode) -> Column | None:
    """``start <= cursor < end``; rows with a NULL cursor never match. None on a full refresh."""
    if not mode.incremental:
        return None
    kind = _need(schema, spec, spec.cursor_field)
    cursor = column(spec.cursor_field)
    return (cursor >= typed_literal(mode.start, kind)) & (cursor < typed_literal(mode.end, kind))


def equality_predicates(schema: T.StructType, spec: StreamSpec, filters: Mapping[str, Any]) -> list[Column]:
    """One equality per filter; a filter value of None compares with NULL and matches nothing."""
    return [column(name) == typed_literal(value, _need(schema, spec, name)) for name, value in filters.items()]


def predicate(schema: T.StructType, spec: StreamSpec, mode: Mode) -> Column | None:
    """The whole source predicate of a stream, or None if every row is wanted."""
    window = window_predicate(schema, spec, mode)
    parts = ([window] if window is not None else []) + equality_predicates(schema, spec, spec.filters)
    return reduce(and_, parts) if parts else None


def read_columns(schema: T.StructType, spec: StreamSpec) -> list[str]:
    """Columns to read, in source order; key, cursor and filter columns are always among them."""
    if not spec.include_columns:
        return schema.names
    wanted = {*spec.include_columns, *spec.keys, *spec.filters, *spec.drop_fields}
    if spec.cursor_field:
        wanted.add(spec.cursor_field)
    return [n for n in schema.names if n in wanted]


def extract(df: DataFrame, spec: StreamSpec, mode: Mode = Mode.full()) -> DataFrame:
    """The rows and raw columns of one stream; both reach the scan through Catalyst."""
    validate(df.schema, spec, mode)
    where = predicate(df.schema, spec, mode)
    rows = df if where is None else df.where(where)
    return rows.select(*[column(n) for n in read_columns(df.schema, spec)])


def stream_count(
    df: DataFrame, spec: StreamSpec, mode: Mode = Mode.full(), by: Sequence[str] = ()
) -> DataFrame:
    """``count(1)`` under the predicates of the scan, as column ``n``, optionally per group."""
    validate(df.schema, spec, mode)
    where = predicate(df.schema, spec, mode)
    rows = df if where is None else df.where(where)
    n = F.count(F.lit(1)).alias("n")
    return rows.groupBy(*[column(c) for c in by]).agg(n) if by else rows.agg(n)
