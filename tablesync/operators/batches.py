"""Appending by directory: every batch of every stream has a folder of its own.

Below a table lie ``dt=<sync date>/sync__stream=<stream>/sync__batch=<batch>`` folders. A batch is written
with dynamic partition overwrite: its files are staged beside the table and take the place of the
folder when the job commits. So a batch written again replaces itself, a lost run leaves
nothing that another one could take for its own, and no counts or marks are needed to tell.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.errors import DestinationError
from tablesync.operators.extract import column
from tablesync.spec import StreamSpec, SyncContext
from tablesync.workspace import Folder

DAY, STREAM, BATCH = "dt", "sync__stream", "sync__batch"


def stream_identity(spec: StreamSpec, namespace: str = "") -> str:
    """What tells streams apart that are appended to one folder: source, schema, table, query and tenant."""
    return json.dumps([namespace, spec.schema_name, spec.name, sorted((k, str(v)) for k, v in spec.filters.items())])


def stream_folder(spec: StreamSpec, namespace: str = "") -> str:
    """A readable folder name that no other stream has."""
    readable = re.sub("[^A-Za-z0-9_.-]", "_", spec.qualified_name)
    return f"{readable}-{hashlib.md5(stream_identity(spec, namespace).encode()).hexdigest()[:12]}"


def batch_place(spec: StreamSpec, ctx: SyncContext, namespace: str = "") -> dict[str, str]:
    """The partition values of a stream's batch, outermost first."""
    return {DAY: f"{ctx.synced_at.date()}", STREAM: stream_folder(spec, namespace), BATCH: str(ctx.batch_id)}


def append_batch(
    df: DataFrame,
    root: str,
    place: Mapping[str, str],
    by: Sequence[str] = (),
    arrange: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    **options,
) -> int:
    """Write a batch to its place under ``root``, or under every folder of the columns ``by``; returns its rows.

    The values of ``place`` are constants, so rows stay in their tasks unless ``arrange`` moves them. A batch
    without rows replaces nothing, so its folder is removed; with ``by``, values without rows keep what they had.
    """
    clash = sorted({c.lower() for c in df.columns} & set(place))
    if clash:
        raise DestinationError(f"columns {clash} are names of folders of this layout; rename or drop them")
    seen = Observation()
    rows = arrange(df.observe(seen, F.count(F.lit(1)).alias("n")))
    constants = {k: F.lit(v).cast("date") if k == DAY else F.lit(v) for k, v in place.items()}
    writer = rows.withColumns(constants).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options)
    writer.partitionBy(*by, *place).parquet(root)
    n = int(seen.get.get("n", 0))  # a plan that is empty for certain may be written without being observed
    if not n and not by:
        Folder(df.sparkSession, "/".join([root, *(f"{k}={v}" for k, v in place.items())])).remove()
    return n


def batch_rows(spark: SparkSession, root: str, schema: T.StructType, place: Mapping[str, str]) -> DataFrame:
    """The rows under ``root`` whose folders have the values of ``place``, pruned to them, with the columns of ``schema``."""
    kinds = [T.StructField(c, T.DateType() if c == DAY else T.StringType()) for c in (DAY, STREAM, BATCH)]
    names = {f.name for f in schema.fields}
    found = spark.read.schema(T.StructType([*schema.fields, *[k for k in kinds if k.name not in names]])).parquet(root)
    for name, value in place.items():
        found = found.where(column(name) == (F.lit(value).cast("date") if name == DAY else F.lit(value)))
    return found.select(*[column(f.name) for f in schema.fields])
