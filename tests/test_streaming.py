"""The streaming forms: guarded upsert, replay, late data, append, rate feed."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from tablesync.sinks.snapshot import SnapshotTable
from tablesync.spec import Bookkeeping
from tablesync.streaming.upsert import batch_upserter, file_feed, rate_feed, stream_append, stream_upsert
from tablesync.workspace import fresh_folder

DDL = "k bigint, at bigint, v string"


def frame(spark, data):
    return spark.createDataFrame(data, DDL)


def drive(spark, folder, table, batches, **kw):
    for batch in batches:
        frame(spark, batch).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
        feed = file_feed(spark, f"{folder}/feed", frame(spark, []).schema)
        stream_upsert(feed, table, ["k"], "at", f"{folder}/checkpoint", **kw).awaitTermination()


def test_x1_x2_late_batches_do_not_go_backwards(spark):
    folder = fresh_folder(spark, "stream")
    table = SnapshotTable(spark, f"{folder}/target", 3)
    drive(spark, folder, table, [[(1, 5, "e"), (2, 5, "e")], [(1, 3, "late"), (3, 1, "a")], [(2, 6, "f"), (2, 7, "g")]])
    assert rows(table.read()) == [(1, 5, "e"), (2, 7, "g"), (3, 1, "a")]


def test_x3_a_replayed_batch_changes_nothing(spark):
    table = SnapshotTable(spark, fresh_folder(spark, "replay"))
    apply = batch_upserter(table, ["k"], "at", Bookkeeping(batch_id=True))
    apply(frame(spark, [(1, 1, "a"), (2, 1, "a")]), 0)
    apply(frame(spark, [(1, 2, "b")]), 1)
    want = rows(table.read())
    apply(frame(spark, [(1, 2, "b")]), 1)
    assert rows(table.read()) == want == [(1, 2, "b", "1"), (2, 1, "a", "0")]
    apply(frame(spark, [(1, 1, "a"), (2, 1, "a")]), 0)
    assert rows(table.read()) == want


def test_x1_one_file_per_micro_batch(spark):
    folder = fresh_folder(spark, "stream")
    for i in range(3):
        frame(spark, [(1, i, str(i))]).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    table = SnapshotTable(spark, f"{folder}/target")
    feed = file_feed(spark, f"{folder}/feed", frame(spark, []).schema, maxFilesPerTrigger=1)
    run = stream_upsert(feed, table, ["k"], "at", f"{folder}/checkpoint")
    run.awaitTermination()
    assert rows(table.read()) == [(1, 2, "2")] and sum(p["numInputRows"] > 0 for p in run.recentProgress) == 3


def test_x2_append_drops_copies_within_the_delay(spark):
    folder = fresh_folder(spark, "append")
    at = lambda minute: dt.datetime(2025, 1, 1, 0, minute)
    data = [(1, at(0)), (1, at(1)), (2, at(2))]
    df = spark.createDataFrame(data, "k bigint, at timestamp")
    df.coalesce(1).write.parquet(f"{folder}/feed")
    feed = file_feed(spark, f"{folder}/feed", df.schema)
    stream_append(feed, f"{folder}/out", ["k"], "at", "10 minutes", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    assert rows(out.groupBy("k").count()) == [(1, 1), (2, 1)]
    assert out.select("dt").first()[0] == dt.date(2025, 1, 1)


def test_x4_rate_feed_has_the_lead_columns(spark):
    feed = rate_feed(spark)
    assert feed.isStreaming and feed.columns == ["id", "customer_id", "lead_score", "last_modified"]
    same = spark.range(3).select(F.col("id").alias("value"), F.current_timestamp().alias("timestamp"))
    assert same.count() == 3
