"""Plan shapes that must hold at any size: pushdown, pruning, partial work before each shuffle."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tablesync.functions.sizing import spread_for_write
from tablesync.operators import fanout, integrity, runlog, upsert
from tablesync.operators.augment import augment
from tablesync.operators.extract import extract, stream_count
from tablesync.plans import catalogue
from tablesync.plans.stage import stage_dataset
from tablesync.spec import Bookkeeping, Mode, StreamSpec, SyncContext
from tablesync.workspace import in_parallel


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tree(df) -> str:
    """The operator tree only, without the details of each operator."""
    return plan_of(df).split("\n\n")[0]


def before_exchange(df, operator: str) -> bool:
    """Does ``operator`` run below (before) the first shuffle?"""
    below = tree(df).split("Exchange", 1)
    return len(below) == 2 and operator in below[1]


def test_a_map_only_stream_has_no_shuffle(spark, events):
    spec = StreamSpec("events", "", "event_id", "ts", {"event_type": "click"})
    df = augment(extract(events, spec, Mode.window("2024-01-10", "2024-01-12")), SyncContext.at("2025-01-10"),
                 Bookkeeping(True, True, "1", True), drop=["event_type"])
    assert "Exchange" not in tree(df) and "Python" not in tree(df)


def test_counts_read_only_predicate_columns(events):
    counted = stream_count(events, StreamSpec("events", "", "event_id", "ts"), Mode.window("2024-01-10", "2024-01-12"))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan_of(counted)
    assert before_exchange(counted, "HashAggregate")


def test_upsert_shuffles_only_keys_of_the_stage(spark, small, no_broadcast):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    stage = orders.where("o_orderdate >= '2001-01-01'")
    plan = plan_of(upsert.upsert_replace(orders, stage, ["o_orderkey"]))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert tree(upsert.upsert_replace(orders, stage, ["o_orderkey"])).count("Exchange") == 2
    unique = upsert.upsert_replace(orders, stage, ["o_orderkey"], unique=True)
    assert "HashAggregate" not in tree(unique) and tree(unique).count("Exchange") == 2


def test_guard_reads_only_key_and_cursor_of_the_target(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    stage = orders.where("o_orderdate >= '2001-01-01'")
    fresh = upsert.not_older(orders, stage, ["o_orderkey"], "o_orderdate")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(fresh))
    assert schemas.count("o_orderkey:bigint,o_orderdate:timestamp_ntz") >= 2


def test_gaps_and_orphans_aggregate_before_the_shuffle(spark, small, events):
    gaps = runlog.run_gaps(events, timedelta(hours=27), by="user_id", at="ts")
    assert before_exchange(gaps, "HashAggregate") and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan_of(gaps)
    lines, orders = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("lineitem", "orders"))
    assert before_exchange(integrity.orphans(lines, orders, {"l_orderkey": "o_orderkey"}), "HashAggregate")


@pytest.mark.parametrize("name", ["latest_run", "latest_run_per_execution", "progress_summary", "dedupe_latest"])
def test_newest_rows_are_cut_before_the_shuffle(spark, small, name):
    assert before_exchange(catalogue.QUERIES[name](spark, small), "WindowGroupLimit")


def test_pages_and_previews_are_top_k(spark, small):
    for name in ("run_listing", "console_preview"):
        plan = tree(catalogue.QUERIES[name](spark, small))
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_fanout_scans_once_and_broadcasts_a_counted_side(spark, events, no_broadcast):
    recipients = events.select(F.col("event_type").alias("tenant_id")).distinct()
    out = fanout.tenant_rows(events, recipients, StreamSpec("events", "", "event_id", "ts"), "event_type")
    assert "BroadcastHashJoin" in tree(out) and "SortMergeJoin" not in tree(out)
    assert "ReadSchema: struct<event_type:string>" in plan_of(out)


def test_fanout_falls_back_to_a_shuffle_for_many_recipients(spark, events, no_broadcast, monkeypatch):
    monkeypatch.setattr("tablesync.operators.fanout.broadcast_if_small", lambda df: df)
    recipients = events.select(F.col("event_type").alias("tenant_id")).distinct()
    out = fanout.tenant_rows(events, recipients, StreamSpec("events", "", "event_id", "ts"), "event_type")
    assert "SortMergeJoin" in tree(out) and out.count() == events.count()


def test_large_folders_are_salted_and_small_ones_are_not(spark, monkeypatch):
    monkeypatch.setattr("tablesync.functions.sizing.SMALL_WRITE_BYTES", 0)
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("p"))
    counts = df.groupBy("p").count().withColumnRenamed("count", "n")
    plain = spread_for_write(df, "p", counts, 2000)
    assert "Join" not in tree(plain) and "Exchange" in tree(plain)
    salted = spread_for_write(df, "p", counts, 100)
    assert "BroadcastHashJoin" in tree(salted) and salted.columns == df.columns and salted.count() == 1000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = spread_for_write(df, "p", counts, 100).select("p", F.spark_partition_id().alias("task")).distinct()
        spread = dict(placed.groupBy("p").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert spread["cold"] == 1 and spread["hot"] > 1


def test_threads_keep_the_job_group(spark):
    spark.sparkContext.setJobGroup("mine", "mine")
    in_parallel(spark, lambda n: spark.range(n).count(), [10, 20], 2)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("mine")) >= 2
    spark.sparkContext.setJobGroup("", "")


def test_staging_counts_in_the_writing_job(spark, events):
    from tablesync.dataset import Dataset, Stream

    ds = Dataset("ns", (Stream(StreamSpec("events"), events),), SyncContext.at("2025-01-10"))
    spark.sparkContext.setJobGroup("stage", "stage")
    staged = stage_dataset(ds)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("stage")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) == 1 and staged.streams[0].rows == events.count()


def test_only_large_reads_are_gathered(spark, events, monkeypatch):
    from tablesync.functions import sizing

    assert sizing.clustered_for_write(events) is events
    monkeypatch.setattr(sizing, "GATHER_ABOVE_BYTES", 1000)
    assert "Exchange" in tree(sizing.clustered_for_write(events))
