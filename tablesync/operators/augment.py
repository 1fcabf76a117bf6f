"""Dropping columns and appending constant, computed and bookkeeping columns."""

from __future__ import annotations

import gc
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.errors import StreamMissingField
from tablesync.functions.checksum import row_checksum
from tablesync.functions.moments import instant_literal
from tablesync.operators.extract import column
from tablesync.spec import Bookkeeping, SyncContext

#: An extra column: ``(type, constant)`` or a function from the raw DataFrame to a Column.
Extra = tuple[str, Any] | Callable[[DataFrame], Column]


#: Rows, and bytes of them, that a Python worker holds at once; Spark's own bounds let a few thousand texts fill it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(raw: DataFrame) -> None:
    """Bound the Arrow batches of the session by :data:`BATCH`; smaller bounds stay."""
    conf = raw.sparkSession.conf
    for name, most in BATCH.items():
        if not 0 < int(conf.get(name).rstrip("bB")) <= most:
            conf.set(name, str(most))


def vectorised(fn: Callable[..., pd.Series], kind: str, *names: str) -> Callable[[DataFrame], Column]:
    """A computed field that Column functions cannot express: ``fn`` gets the columns ``names`` as pandas Series.

    It runs over Arrow batches beside the plan's other columns, in the tasks that have the rows; nothing moves.
    Batches are small (:data:`BATCH`), whatever a task has, so ``fn`` may only depend on the row itself.
    """

    def batch(*columns: pd.Series) -> pd.Series:
        gc.collect()  # a Series whose ``str`` was used is a cycle, so the texts of earlier batches are still there
        return fn(*columns)

    def computed(raw: DataFrame) -> Column:
        small_batches(raw)
        return F.pandas_udf(batch, kind)(*[column(n) for n in names])

    return computed


def bookkeeping_columns(raw: DataFrame, ctx: SyncContext, marks: Bookkeeping) -> list[Column]:
    """The label columns in their fixed order; the checksum sees the raw columns, before drops."""
    out = []
    if marks.batch_id:
        out.append(F.lit(ctx.batch_id).alias(ctx.column("batch_id")))
    if marks.checksum:
        out.append(row_checksum(raw, marks.checksum).alias(ctx.column("checksum")))
    if marks.version:
        out.append(F.lit(str(marks.version)).alias(ctx.column("version")))
    if marks.last_sync:
        out.append(instant_literal(ctx.synced_at, ctx.timestamp_type).alias(ctx.column("last_synced_at")))
    return out


def _extra_column(raw: DataFrame, name: str, extra: Extra) -> Column:
    if callable(extra):
        return extra(raw).alias(name)
    kind, value = extra
    return F.lit(value).cast(kind).alias(name)


def augment(
    raw: DataFrame,
    ctx: SyncContext,
    marks: Bookkeeping = Bookkeeping(),
    drop: Sequence[str] = (),
    extra: Mapping[str, Extra] | None = None,
) -> DataFrame:
    """One projection: kept raw columns, then extra columns, then bookkeeping columns."""
    for name in drop:
        if name not in raw.columns:
            raise StreamMissingField(f"cannot drop {name}: no such field")
    kept = [column(n) for n in raw.columns if n not in set(drop)]
    extras = [_extra_column(raw, name, e) for name, e in (extra or {}).items()]
    return raw.select(*kept, *extras, *bookkeeping_columns(raw, ctx, marks))
