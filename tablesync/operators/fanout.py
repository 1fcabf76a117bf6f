"""One pass over a table for all recipients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.functions.sizing import ROWS_PER_WRITER, broadcast_if_small, spread_for_write
from tablesync.operators.augment import augment
from tablesync.operators.batches import append_batch, batch_place
from tablesync.operators.extract import column, extract
from tablesync.spec import Bookkeeping, Mode, StreamSpec, SyncContext

def tenant_rows(
    df: DataFrame,
    recipients: DataFrame,
    spec: StreamSpec,
    tenant_column: str,
    mode: Mode = Mode.full(),
    ctx: SyncContext | None = None,
    marks: Bookkeeping = Bookkeeping(),
) -> DataFrame:
    """The rows of every recipient in one scan, with ``tenant_id`` in front of the stream's columns.

    Each (stream, tenant) export of the per-recipient form is the slice of one
    ``tenant_id``. The recipient list is broadcast only after its size was counted.
    """
    raw = extract(df, spec, mode)
    ctx = ctx or SyncContext.at()
    shaped = augment(
        raw, ctx, marks, drop=[tenant_column, *[d for d in spec.drop_fields if d != tenant_column]],
        extra={"__tenant": lambda r: column(tenant_column)},
    )
    kind = shaped.schema["__tenant"].dataType
    wanted = recipients.select("tenant_id").distinct()
    if wanted.schema["tenant_id"].dataType != kind:
        wanted = wanted.withColumn("__key", F.col("tenant_id").try_cast(kind))
    else:
        wanted = wanted.withColumn("__key", F.col("tenant_id"))
    joined = shaped.join(broadcast_if_small(wanted), F.col("__tenant") == F.col("__key"))
    return joined.select("tenant_id", *[column(n) for n in shaped.columns if n != "__tenant"])


def export_all_tenants(
    rows: DataFrame,
    root: str,
    spec: StreamSpec,
    ctx: SyncContext,
    batch_size: int | None = None,
    rows_per_writer: int = ROWS_PER_WRITER,
    namespace: str = "",
) -> str:
    """Write :func:`tenant_rows` of a stream as ``tenant_id=…/dt=…`` folders, in which every batch of every stream has its own.

    Rows per tenant are counted first, on the tenant column alone, so that a tenant with
    a large share of the rows is written by many tasks and a small one by one. A batch that is
    written again replaces itself; several streams may share a root and a batch id.
    """
    counts = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))

    def arranged(df: DataFrame) -> DataFrame:
        return spread_for_write(df, "tenant_id", counts, rows_per_writer)

    options = {"maxRecordsPerFile": batch_size} if batch_size else {}
    append_batch(rows, root, batch_place(spec, ctx, namespace), ["tenant_id"], arranged, **options)
    return root
