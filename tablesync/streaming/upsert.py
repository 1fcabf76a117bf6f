"""The incremental sync as a stream: each micro-batch is upserted by key.

Replays and late data are handled by the cursor guard: a row is replaced only by one
that is not older, so applying a batch twice, or an old batch late, changes nothing.
No watermark is needed and no state is kept besides the target itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablesync.operators.augment import augment
from tablesync.operators.extract import column
from tablesync.sinks.snapshot import SnapshotTable
from tablesync.spec import Bookkeeping, SyncContext


def file_feed(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """A folder as a stream of new Parquet files."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def rate_feed(spark: SparkSession, rows_per_second: int = 50, tenants: int = 10) -> DataFrame:
    """An endless feed of synthetic leads for tests of a running sync."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    lead = F.pmod(F.xxhash64("value"), F.lit(1000))
    return rate.select(
        lead.alias("id"),
        F.concat(F.lit("Customer"), (F.pmod(lead, F.lit(tenants)) + 1).cast("string")).alias("customer_id"),
        F.pmod(F.xxhash64("value", F.lit(1)), F.lit(101)).cast("int").alias("lead_score"),
        F.col("timestamp").alias("last_modified"),
    )


def batch_upserter(
    target: SnapshotTable,
    keys: Sequence[str],
    cursor: str,
    marks: Bookkeeping = Bookkeeping(),
    prefix: str = "sync__",
    synced_at=None,
):
    """The ``foreachBatch`` function: dedupe, guard, upsert; the batch number is the batch id."""
    def apply(batch: DataFrame, batch_no: int) -> None:
        if batch.isEmpty():
            return
        ctx = SyncContext.at(synced_at, batch_id=str(batch_no), prefix=prefix)
        target.upsert(augment(batch, ctx, marks), keys, cursor, dedupe="latest", guard="cursor")

    return apply


def stream_upsert(
    feed: DataFrame,
    target: SnapshotTable,
    keys: Sequence[str],
    cursor: str,
    checkpoint: str,
    trigger: Mapping[str, object] | None = None,
    marks: Bookkeeping = Bookkeeping(),
    **options,
) -> StreamingQuery:
    """Start the stream; by default it takes all there is and stops, as a scheduled run does.

    ``checkpoint`` must lie in storage every executor and a restarted driver reach.
    """
    writer = feed.writeStream.foreachBatch(batch_upserter(target, keys, cursor, marks, **options))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_append(
    feed: DataFrame,
    root: str,
    keys: Sequence[str],
    event_time: str,
    delay: str,
    checkpoint: str,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Append-only hive layout: copies of a key that arrive within ``delay`` of each other are dropped.

    The keys seen are state of the query: a restart from the checkpoint knows those of earlier runs. Rows older
    than the watermark, the newest time seen less ``delay``, are dropped; keys leave the state with it.
    """
    rows = feed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    dated = rows.withColumn("dt", F.to_date(column(event_time)))
    writer = dated.writeStream.format("parquet").partitionBy("dt").option("path", root)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
