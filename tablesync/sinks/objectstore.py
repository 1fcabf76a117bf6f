"""Parquet in object stores or any Hadoop file system: a staging and a hive layout."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from tablesync.dataset import Dataset, Stream
from tablesync.errors import DestinationError
from tablesync.functions.sizing import clustered_for_write
from tablesync.operators.batches import BATCH, append_batch, batch_place, batch_rows, stream_identity
from tablesync.sinks.base import Sink
from tablesync.spec import StreamSpec, SyncContext
from tablesync.workspace import Folder

FORMATS = ("staging", "hive")


def clean_prefix(prefix: str | None) -> str:
    return (prefix or "").strip("/")


def bucket_root(scheme: str, bucket: str, prefix: str | None = "", host: str = "") -> str:
    """``scheme://bucket[host]/prefix``; a scheme already in front of the bucket is removed as a whole."""
    bucket = bucket.split("://", 1)[-1].strip("/")
    return "/".join(p for p in (f"{scheme}://{bucket}{host}", clean_prefix(prefix)) if p)


def staging_path(root: str, namespace: str, spec: StreamSpec, ctx: SyncContext) -> str:
    """``root/namespace/schema__table/YYYY-MM-DD/batch``: one folder holds exactly one batch."""
    return f"{root.rstrip('/')}/{namespace}/{spec.folder}/{ctx.synced_at:%Y-%m-%d}/{ctx.batch_id}"


def hive_root(root: str, spec: StreamSpec) -> str:
    """``root/table``, below which lie ``dt=YYYY-MM-DD`` folders of the sync date, and in them one per stream and batch."""
    return f"{root.rstrip('/')}/{spec.name}"


def _writer(df: DataFrame, mode: str, batch_size: int | None, compression: str):
    writer = df.write.mode(mode).option("compression", compression.lower())
    return writer.option("maxRecordsPerFile", batch_size) if batch_size else writer


def write_staging(
    df: DataFrame, root: str, namespace: str, spec: StreamSpec, ctx: SyncContext,
    batch_size: int | None = None, compression: str = "snappy",
) -> str:
    """Write one batch into its own folder; writing the same batch again replaces it."""
    path = staging_path(root, namespace, spec, ctx)
    _writer(df, "overwrite", batch_size, compression).parquet(path)
    return path


def write_hive(
    df: DataFrame, root: str, spec: StreamSpec, ctx: SyncContext,
    batch_size: int | None = None, compression: str = "snappy", namespace: str = "",
) -> str:
    """Write one batch of a stream below the ``dt`` folder of its sync date, a map-only job.

    Streams of several schemas share the folder of their table name; each batch of each has a folder
    of its own in it, so a repeated run replaces its rows, whatever else the table holds.
    """
    path, options = hive_root(root, spec), {"compression": compression.lower()}
    append_batch(df, path, batch_place(spec, ctx, namespace), **options, **({"maxRecordsPerFile": batch_size} if batch_size else {}))
    return path


class ObjectStoreSink(Sink):
    """``connect``: ``root`` (any Hadoop URI) or a bucket, and ``format`` (``staging`` or ``hive``).

    ``batch_size`` caps the rows of a file; unset, files have the size of a write task.
    ``compact`` gathers the rows of a selective read into few files first.
    """

    label = "object"
    scheme: str | None = None
    checkable = True

    @property
    def single_pass(self) -> bool:
        return not self.connect.get("compact")

    def __init__(self, spark, config=None):
        super().__init__(spark, config)
        self.format = str(self.connect.get("format", "staging")).lower()
        if self.format not in FORMATS:
            raise DestinationError(f"format {self.format} is not supported, use one of {FORMATS}")

    @property
    def root(self) -> str:
        return self.connect["root"]

    @property
    def file_options(self) -> dict[str, Any]:
        parquet = self.config.get("parquet") or self.connect.get("parquet") or {}
        return {"batch_size": self.config.get("batch_size"), "compression": parquet.get("compression", "snappy")}

    def base(self, dataset: Dataset) -> str:
        """The root of this run; a trial run gets a folder of its own, away from real tables."""
        return f"{self.root.rstrip('/')}/trial-{dataset.ctx.batch_id}" if self.trial else self.root

    def path(self, stream: Stream, dataset: Dataset) -> str:
        if self.format == "hive":
            return hive_root(self.base(dataset), stream.spec)
        return staging_path(self.base(dataset), dataset.namespace, stream.spec, dataset.ctx)

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        df, root = stream.df, self.base(dataset)
        if self.connect.get("compact"):
            df = clustered_for_write(df)
        if self.format == "hive":
            write_hive(df, root, stream.spec, dataset.ctx, namespace=dataset.namespace, **self.file_options)
        else:
            write_staging(df, root, dataset.namespace, stream.spec, dataset.ctx, **self.file_options)

    def missing(self, stream: Stream, dataset: Dataset) -> bool:
        """No batch of any day; a staged batch is a delivery of its own and misses nothing."""
        return self.format == "hive" and not Folder(self.spark, self.path(stream, dataset)).exists()

    def place(self, stream: Stream, dataset: Dataset) -> str:
        return self.path(stream, dataset)

    def target_key(self, stream: Stream, dataset: Dataset) -> str:
        return f"{self.path(stream, dataset)} {stream_identity(stream.spec, dataset.namespace)}"

    def loaded_rows(self, stream: Stream, dataset: Dataset, target: DataFrame) -> int:
        """Rows of the batch's own folder."""
        if self.format != "hive":
            return super().loaded_rows(stream, dataset, target)
        place = batch_place(stream.spec, dataset.ctx, dataset.namespace)
        return batch_rows(self.spark, self.path(stream, dataset), stream.df.schema, place).count()

    def target(self, stream: Stream, dataset: Dataset) -> DataFrame | None:
        """The staged batch; of a hive table the stream's rows of all batches of the day."""
        path = self.path(stream, dataset)
        if not Folder(self.spark, path).exists():
            return None
        if self.format != "hive":
            return self.spark.read.schema(stream.df.schema).parquet(path)
        place = batch_place(stream.spec, dataset.ctx, dataset.namespace)
        return batch_rows(self.spark, path, stream.df.schema, {k: v for k, v in place.items() if k != BATCH})

    def clean(self, dataset: Dataset) -> None:
        if self.trial:
            Folder(self.spark, self.base(dataset)).remove()


class S3Sink(ObjectStoreSink):
    """``connect``: ``s3_bucket``, ``s3_prefix``; credentials belong to the ``s3a`` file system settings."""

    scheme = "s3a"

    @property
    def root(self) -> str:
        return self.connect.get("root") or bucket_root("s3a", self.connect["s3_bucket"], self.connect.get("s3_prefix"))


class GcsSink(ObjectStoreSink):
    """``connect``: ``gcs_bucket_name``, ``gcs_bucket_path``."""

    scheme = "gs"

    @property
    def root(self) -> str:
        connect = self.connect
        return connect.get("root") or bucket_root("gs", connect["gcs_bucket_name"], connect.get("gcs_bucket_path"))


class AbsSink(ObjectStoreSink):
    """``connect``: ``blob_container``, ``blob_account``, ``blob_prefix``."""

    scheme = "abfss"

    @property
    def root(self) -> str:
        connect = self.connect
        host = f"@{connect['blob_account']}.dfs.core.windows.net" if connect.get("blob_account") else ""
        return connect.get("root") or bucket_root("abfss", connect["blob_container"], connect.get("blob_prefix"), host)


def hadoop_settings(vendor: str, connect: Mapping[str, Any]) -> dict[str, str]:
    """File-system settings for the credentials in a connection config (``spark.hadoop.`` keys)."""
    auth = connect.get("auth_type")
    if vendor == "s3":
        if auth != "basic":
            raise ValueError(f"s3 does not support auth type {auth!r}")
        out = {
            "spark.hadoop.fs.s3a.access.key": connect["aws_access_key_id"],
            "spark.hadoop.fs.s3a.secret.key": connect["aws_secret_access_key"],
        }
        if connect.get("s3_region"):
            out["spark.hadoop.fs.s3a.endpoint.region"] = connect["s3_region"]
        return out
    if vendor == "gcs":
        return {
            "spark.hadoop.fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE",
            "spark.hadoop.fs.gs.auth.service.account.json.keyfile": connect["service_account_file"],
        }
    if vendor == "abs":
        if auth != "connection_string":
            raise ValueError(f"abs does not support auth type {auth!r}")
        parts = dict(p.split("=", 1) for p in connect["blob_connection_string"].split(";") if p)
        account = parts["AccountName"]
        return {f"spark.hadoop.fs.azure.account.key.{account}.dfs.core.windows.net": parts["AccountKey"]}
    raise ValueError(f"unknown object store: {vendor}")
