"""File layouts, snapshot tables, catalog, console, compound and trial runs."""

import datetime as dt
import json
from decimal import Decimal
from functools import partial

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablesync import get_destination, get_destination_by_vendor, register_sink
from tablesync.dataset import Dataset, Stream
from tablesync.errors import DestinationError, DestinationStreamInvalidSchema, IntegrityCheckFailed, StreamError
from tablesync.functions.sizing import spread_for_write
from tablesync.operators.upsert import merge_into
from tablesync.plans.stage import stage_dataset, stage_snapshot
from tablesync.sinks.base import Sink
from tablesync.sinks.catalog import CatalogSink, register_table
from tablesync.sinks.compound import CompoundSink, multi_sink
from tablesync.sinks.console import ConsoleSink
from tablesync.sinks.objectstore import (
    ObjectStoreSink, bucket_root, hadoop_settings, hive_root, staging_path, write_hive, write_staging,
)
from tablesync.sinks import snapshot
from tablesync.sinks.snapshot import PART, SnapshotSink, SnapshotTable, write_snapshot
from tablesync.sources.fixture import FixtureSource
from tablesync.spec import Mode, StreamSpec, SyncContext
from tablesync.workspace import Folder, fresh_folder

SPEC = StreamSpec("leads", "crm", "id", "at")
CTX = SyncContext.at("2025-01-10T15:43:12Z", "b1")


@pytest.fixture
def folder(spark):
    return fresh_folder(spark, "test")


def marked(spark, n=10, batch="b1"):
    return spark.range(n).select("id", F.lit(batch).alias("sync__batch_id"))


def dataset(*streams, ctx=CTX, mode=Mode.full()):
    return Dataset("ns", tuple(streams), ctx, mode)


# ---- K6, K7, K9, K10, K8


def test_k6_staging_layout(spark, folder):
    assert staging_path("root/", "ns", SPEC, CTX) == "root/ns/crm__leads/2025-01-10/b1"
    path = write_staging(marked(spark), folder, "ns", SPEC, CTX)
    write_staging(marked(spark), folder, "ns", SPEC, CTX)
    assert spark.read.parquet(path).count() == 10, "the same batch written again replaces itself"


def test_k7_hive_layout(spark, folder):
    assert hive_root("root", SPEC) == "root/leads"
    path = write_hive(marked(spark), folder, SPEC, CTX)
    write_hive(marked(spark, 5, "b2"), folder, SPEC, SyncContext.at("2025-01-11", "b2"))
    got = spark.read.parquet(path).groupBy("dt").count()
    assert rows(got) == [(dt.date(2025, 1, 10), 10), (dt.date(2025, 1, 11), 5)]


def test_k7_append_is_a_map_only_job(spark, folder):
    spark.sparkContext.setJobGroup("hive", "hive")
    write_hive(spark.range(0, 1000, 1, 4), folder, SPEC, CTX)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("hive")
    stages = [s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert len(stages) == 1


def test_k7_a_repeated_unstaged_batch_is_counted_not_written(spark, folder):
    for _ in range(2):
        sink = ObjectStoreSink(spark, {"connect": {"root": folder, "format": "hive"}})
        ds = dataset(Stream(SPEC, marked(spark)))
        sink.write(ds)
        assert sink.check(ds) == {"crm.leads": 10}


def test_streams_are_written_in_parallel(spark, folder):
    streams = [Stream(StreamSpec(f"t{i}", "s"), marked(spark, i + 1)) for i in range(5)]
    sink = ObjectStoreSink(spark, {"connect": {"root": folder}, "parallel": 3})
    ds = dataset(*streams)
    sink.write(ds)
    assert sink.check(ds) == {f"s.t{i}": i + 1 for i in range(5)}


def test_k7_repeated_batch_adds_nothing(spark, folder):
    path = write_hive(marked(spark), folder, SPEC, CTX)
    write_hive(marked(spark), folder, SPEC, CTX)
    assert spark.read.parquet(path).count() == 10
    write_hive(marked(spark, 11), folder, SPEC, CTX)
    assert spark.read.parquet(path).count() == 11, "the batch replaces itself"
    write_hive(marked(spark, 0), folder, SPEC, CTX)
    write_hive(marked(spark, 2, "b2"), folder, SPEC, SyncContext.at("2025-01-10", "b2"))
    assert spark.read.parquet(path).count() == 2


def test_k7_streams_of_equal_size_share_a_folder(spark, folder):
    """Two schemas, one table name, one batch: neither is taken for the other."""
    specs = [StreamSpec("users", schema, "id") for schema in ("eu", "us")]
    for _ in range(2):
        sink = ObjectStoreSink(spark, {"connect": {"root": folder, "format": "hive"}, "parallel": 2})
        ds = dataset(*[Stream(s, marked(spark, 10)) for s in specs])
        sink.write(ds)
        assert sink.check(ds) == {"eu.users": 10, "us.users": 10}
    assert spark.read.parquet(f"{folder}/users").count() == 20


def test_k7_a_lost_run_leaves_nothing_to_another_stream(spark, folder):
    """One stream's run is lost after it wrote; the other has as many rows in the same batch."""
    eu, us = StreamSpec("users", "eu", "id"), StreamSpec("users", "us", "id")
    path = write_hive(marked(spark, 10).where("id < 4"), folder, eu, CTX)
    for spec in (us, eu, us):
        write_hive(marked(spark, 10), folder, spec, CTX)
    assert rows(spark.read.parquet(path).groupBy("sync__stream").count().select("count")) == [(10,), (10,)]


def test_k7_a_failing_replay_keeps_the_batch(spark, folder):
    path = write_hive(marked(spark), folder, SPEC, CTX)
    failing = marked(spark).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        write_hive(failing, folder, SPEC, CTX)
    assert spark.read.parquet(path).count() == 10


def test_k7_folder_names_are_no_columns(spark, folder):
    with pytest.raises(DestinationError, match="sync__batch"):
        write_hive(marked(spark).withColumn("sync__batch", F.lit(1)), folder, SPEC, CTX)


@pytest.mark.parametrize("kind", ["staging", "hive"])
def test_two_streams_of_one_target_are_refused_before_any_write(spark, folder, kind):
    ds = dataset(Stream(SPEC, marked(spark)), Stream(SPEC, marked(spark, 3)))
    for sink in (ObjectStoreSink(spark, {"connect": {"root": folder, "format": kind}}), SnapshotSink(spark, {"connect": {"root": folder}})):
        with pytest.raises(DestinationError, match="one target"):
            sink.write(ds)
    assert Folder(spark, folder).names() == []


def test_k9_rows_per_file(spark, folder):
    path = write_staging(marked(spark, 25).coalesce(1), folder, "ns", SPEC, CTX, batch_size=10)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().select("count")
    assert rows(files) == [(10,), (10,), (5,)]


@pytest.mark.parametrize(("codec", "suffix"), [("none", ".parquet"), ("zstd", ".zstd.parquet"), ("NONE", ".parquet")])
def test_k10_compression(spark, folder, codec, suffix):
    path = write_staging(marked(spark), folder, "ns", SPEC, CTX, compression=codec)
    files = [n for n in Folder(spark, path).names() if n.startswith("part-")]
    assert files and all(n.endswith(suffix) for n in files)
    assert codec == "zstd" or not any(".snappy" in n for n in files)


def test_k8_q11_bucket_roots():
    assert bucket_root("s3a", "s3://sales/", "/x/y/") == "s3a://sales/x/y"
    assert bucket_root("s3a", "sales") == "s3a://sales"
    assert bucket_root("abfss", "box", "p", "@acc.dfs.core.windows.net") == "abfss://box@acc.dfs.core.windows.net/p"


def test_k8_stores_map_their_config(spark):
    s3 = get_destination(spark, "destination-s3", {"connect": {"s3_bucket": "s3://sales", "s3_prefix": "p"}})
    gcs = get_destination(spark, "destination-gcs", {"connect": {"gcs_bucket_name": "sales", "gcs_bucket_path": "/p"}})
    az = get_destination(spark, "destination-abs", {"connect": {"blob_container": "box", "blob_account": "acc"}})
    assert (s3.root, gcs.root) == ("s3a://sales/p", "gs://sales/p")
    assert az.root == "abfss://box@acc.dfs.core.windows.net"


def test_k8_unknown_format(spark):
    with pytest.raises(DestinationError):
        get_destination(spark, "destination-s3", {"connect": {"s3_bucket": "x", "format": "avro"}})


def test_k8_credentials_become_file_system_settings():
    got = hadoop_settings("s3", {"auth_type": "basic", "aws_access_key_id": "a", "aws_secret_access_key": "b", "s3_region": "r"})
    assert got["spark.hadoop.fs.s3a.endpoint.region"] == "r"
    text = "DefaultEndpointsProtocol=https;AccountName=acc;AccountKey=abc==;EndpointSuffix=core.windows.net"
    got = hadoop_settings("abs", {"auth_type": "connection_string", "blob_connection_string": text})
    assert got == {"spark.hadoop.fs.azure.account.key.acc.dfs.core.windows.net": "abc=="}
    with pytest.raises(ValueError):
        hadoop_settings("s3", {"auth_type": "iam"})


# ---- K13


def test_k13_stage_counts_while_writing(spark, folder, monkeypatch):
    monkeypatch.setattr("tablesync.functions.sizing.GATHER_ABOVE_BYTES", 0)
    df, n = stage_snapshot(spark.range(1000), f"{folder}/a")
    assert n == df.count() == 1000
    df, n = stage_snapshot(spark.range(0), f"{folder}/b")
    assert n == 0 and df.columns == ["id"]
    df, n = stage_snapshot(spark.range(1000).where("id % 10 = 0"), f"{folder}/c", compact=True)
    assert n == df.count() == 100


@pytest.mark.parametrize("empty", ["where false", "no rows", "empty scan"])
def test_empty_plans_are_counted(spark, folder, empty):
    spark.range(3).write.parquet(f"{folder}/src")
    df = {
        "where false": spark.range(3).where("false"),
        "no rows": spark.createDataFrame([], "id bigint"),
        "empty scan": spark.read.parquet(f"{folder}/src").where("id > 99"),
    }[empty]
    assert stage_snapshot(df, f"{folder}/stage")[1] == 0
    sink = ObjectStoreSink(spark, {"connect": {"root": folder}})
    ds = dataset(Stream(SPEC, df.withColumn("sync__batch_id", F.lit("b1"))))
    sink.write(ds)
    assert sink.check(ds) == {"crm.leads": 0}


def test_k19_a_failed_trial_leaves_nothing(spark, folder):
    class Fails(ObjectStoreSink):
        def write_stream(self, stream, ds):
            super().write_stream(stream, ds)
            raise OSError("full")

    sink = Fails(spark, {"connect": {"root": folder}, "drop_after_complete": True})
    with pytest.raises(OSError):
        sink.write(dataset(Stream(SPEC, marked(spark))))
    assert Folder(spark, folder).names() == []


def test_k13_values_of_all_types_survive_the_stage(spark, folder):
    ddl = ("id bigint, name string, age bigint, salary double, is_active boolean, birth_date date, created_at timestamp, "
           "seen timestamp_ntz, metadata string, binary_data binary, amount decimal(12,2), tags array<string>")  # fmt: skip
    utc = dt.timezone.utc
    data = [
        (1, "ä", 30, 1.5, True, dt.date(1990, 2, 28), dt.datetime(2025, 1, 1, 1, 2, 3, 456789, utc), dt.datetime(2025, 1, 1),
         '{"k": 1}', bytearray(b"\x00\xff"), Decimal("12.30"), ["a", None]),
        (2, "", 0, float("-inf"), False, dt.date(1, 1, 1), dt.datetime(9999, 12, 31, tzinfo=utc), dt.datetime(1900, 1, 1),
         "", bytearray(), Decimal("-0.01"), []),
        (3, *[None] * 11),
    ]
    df = spark.createDataFrame(data, ddl)
    staged, n = stage_snapshot(df, f"{folder}/all")
    assert n == 3 and staged.schema.simpleString() == df.schema.simpleString()
    assert sorted(staged.collect()) == sorted(df.collect())


def test_k13_wide_streams(spark, folder):
    kinds = [F.col("id"), F.col("id").cast("string"), F.col("id") / 2, F.col("id") % 2 == 0]
    wide = spark.range(500).select("id", *[kinds[i % 4].alias(f"c{i}") for i in range(50)])
    staged, n = stage_snapshot(wide, f"{folder}/wide")
    assert n == 500 and staged.exceptAll(wide).isEmpty()


def test_q18_streams_of_two_schemas_do_not_collide(spark):
    a, b = StreamSpec("t", "x"), StreamSpec("t", "y")
    staged = stage_dataset(dataset(Stream(a, spark.range(3)), Stream(b, spark.range(5))))
    assert [s.rows for s in staged] == [3, 5]
    assert staged.stream("t", "y").df.count() == 5


# ---- A2, K18


def test_a2_q8_integrity_of_file_sinks(spark, folder):
    for kind in ("staging", "hive"):
        sink = ObjectStoreSink(spark, {"connect": {"root": f"{folder}/{kind}", "format": kind}})
        ds = dataset(Stream(SPEC, marked(spark)))
        summaries = sink.write(ds)
        assert sink.check(ds) == {"crm.leads": 10}
        (summary,) = summaries.values()
        assert summary["processed"] == summary["total"] == 10 and summary["percent"] == 100.0


def test_a2_lost_rows_are_reported(spark, folder):
    sink = ObjectStoreSink(spark, {"connect": {"root": folder}})
    ds = dataset(Stream(SPEC, marked(spark), rows=12))
    sink.write(ds)
    with pytest.raises(IntegrityCheckFailed, match="loaded 10, expected 12"):
        sink.check(ds)


def test_q8_an_empty_first_sync_passes_the_check(spark, folder):
    window = Mode.window("2025-01-01", "2025-01-02")
    sink = SnapshotSink(spark, {"connect": {"root": folder}, "mode": window})
    ds = stage_dataset(dataset(Stream(SPEC, marked(spark, 0)), mode=window))
    sink.write(ds)
    assert sink.check(ds) == {}


# ---- J1-J4 on disk, K14-K17


def test_k17_snapshot_upsert_is_idempotent(spark, folder):
    table = SnapshotTable(spark, folder)
    stage = spark.range(5, 15).select("id", F.lit("s").alias("v"))
    table.replace(spark.range(10).select("id", F.lit("t").alias("v")))
    for _ in range(3):
        table.upsert(stage, ["id"])
    want = [(i, "t") for i in range(5)] + [(i, "s") for i in range(5, 15)]
    assert rows(table.read()) == sorted(want, key=lambda t: str(t[0]))


def test_k16_full_refresh_may_change_the_schema(spark, folder):
    table = SnapshotTable(spark, folder)
    table.replace(spark.range(3))
    table.replace(spark.range(2).select(F.col("id").cast("string").alias("name")))
    assert table.read().dtypes == [("name", "string")]


def test_k15_upsert_refuses_another_schema(spark, folder):
    table = SnapshotTable(spark, folder)
    table.replace(spark.range(3))
    with pytest.raises(DestinationStreamInvalidSchema):
        table.upsert(spark.range(3).withColumn("extra", F.lit(1)), ["id"])


def values(spark, n, v):
    return spark.range(n).select("id", F.lit(v).alias("v"))


def parted(spark, folder, parts=5):
    table = SnapshotTable(spark, folder, parts)
    table.replace(spark.range(50).select("id", (F.col("id") % 7).alias("at"), F.lit("t").alias("v")), ["id"])
    return table


def files_by_part(spark, folder):
    found = spark.read.parquet(folder).select(PART, F.input_file_name().alias("f")).distinct().collect()
    return {p: {r.f for r in found if r[PART] == p} for p in {r[PART] for r in found}}


@pytest.mark.parametrize("parts", [1, 5])
def test_a_lost_run_changes_nothing(spark, folder, parts):
    """Lost while it writes, after other tasks of it have written; a full refresh that is lost keeps the old rows too."""
    table = parted(spark, folder, parts)
    before = rows(table.read())
    lost = F.when(F.col("id") == 6, F.raise_error(F.lit("lost"))).otherwise(F.lit("s"))
    stage = table.read().where("id < 7").withColumn("v", lost)
    for run in (lambda: table.upsert(stage, ["id"], "at", "none", on_disk=True), lambda: table.replace(stage, ["id"])):
        with pytest.raises(Exception, match="lost"):
            run()
        assert rows(SnapshotTable(spark, folder).read()) == before
    table.replace(values(spark, 2, "new"), ["id"])
    assert rows(SnapshotTable(spark, folder).read()) == rows(values(spark, 2, "new"))


def test_readers_write_nothing(spark, folder):
    parted(spark, folder)
    before = files_by_part(spark, folder), Folder(spark, folder).names()
    assert SnapshotTable(spark, folder).read().count() == 50
    assert (files_by_part(spark, folder), Folder(spark, folder).names()) == before


def test_untouched_parts_keep_their_files(spark, folder):
    table = parted(spark, folder)
    before = files_by_part(spark, folder)
    stage = spark.createDataFrame([(3, 9, "s")], "id long, at long, v string")
    table.upsert(stage, ["id"], "at", rows=1)
    after = files_by_part(spark, folder)
    assert len(before) == len(after) == 5 and sum(before[p] != after[p] for p in before) == 1
    assert table.read().where("v = 's'").count() == 1 and table.read().count() == 50


def test_any_parquet_reader_sees_the_table(spark, folder):
    table = parted(spark, folder)
    table.upsert(values(spark, 3, "s").withColumn("at", F.lit(1).cast("bigint")), ["id"], "at")
    assert spark.read.parquet(folder).select("id", "at", "v").exceptAll(table.read()).isEmpty()


def test_a_table_keeps_its_cut(spark, folder):
    """Another number of parts, or another key, cannot place a row twice."""
    table = SnapshotTable(spark, folder, 2)
    table.replace(values(spark, 20, "t"), ["id"])
    with pytest.raises(DestinationError, match="full refresh"):
        SnapshotTable(spark, folder, 5).upsert(values(spark, 1, "s"), ["id"])
    by_id = SnapshotTable(spark, f"{folder}-other", 2)
    by_id.replace(spark.range(40).select("id", F.col("id").cast("string").alias("v")), ["id"])
    with pytest.raises(Exception, match="other keys"):
        by_id.upsert(values(spark, 1, "s"), ["v"])
    for i in range(4):
        SnapshotTable(spark, folder).upsert(spark.range(i, i + 1).select("id", F.lit("s").alias("v")), ["id"], rows=1)
    assert rows(table.read()) == rows(values(spark, 4, "s").union(values(spark, 20, "t").where("id > 3")))
    SnapshotTable(spark, folder, 5).replace(values(spark, 9, "u"), ["id"])
    assert table.parts() == 5 and table.read().count() == 9


def test_null_keys_are_spread_over_the_parts(spark, folder):
    table = SnapshotTable(spark, folder, 4)
    base = spark.range(200).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    table.replace(base, ["k"])
    loaded = spark.read.parquet(folder).where("k is null").groupBy(PART).count().collect()
    assert len(loaded) == 4 and max(r["count"] for r in loaded) < 60
    table.upsert(base.where("v < 10").withColumn("v", F.col("v") + 1000), ["k"])
    assert table.read().where("k is null").count() == 105 and table.read().count() == 205


def test_keyed_tables_are_cut_by_their_size(spark, folder, monkeypatch):
    table = SnapshotTable(spark, folder)
    table.replace(spark.range(1000), ["id"])
    assert table.parts() == 1
    monkeypatch.setattr(snapshot, "PART_BYTES", 1000)
    sink = SnapshotSink(spark, {"connect": {"root": folder}})
    staged = stage_dataset(dataset(Stream(StreamSpec("t", "s", "id"), marked(spark, 1000))))
    sink.write(staged)
    assert sink.check(staged) == {"s.t": 1000} and sink.table(staged.streams[0]).parts() > 1


def test_a_table_that_has_grown_is_cut_anew(spark, folder, monkeypatch):
    """A small first load is not one part for ever."""
    table = SnapshotTable(spark, folder)
    table.replace(values(spark, 10, "t"), ["id"])
    monkeypatch.setattr(snapshot, "PART_BYTES", 1500)
    for i in range(1, 4):
        stage = spark.range(300 * i).select("id", F.sha2(F.concat(F.col("id"), F.lit(i)), 256).alias("v"))
        table.upsert(stage, ["id"])
    assert table.parts() > 2 and table.read().count() == 900
    assert table.read().select("id").distinct().count() == 900


def test_empty_tables_keep_schema_and_cut(spark, folder):
    table = SnapshotTable(spark, folder, 3)
    table.replace(values(spark, 0, "t"), ["id"])
    assert table.read().columns == ["id", "v"] and table.read().count() == 0 and table.parts() == 3
    table.upsert(values(spark, 5, "s"), ["id"])
    assert table.read().count() == 5


def test_merge_needs_a_table_format(spark):
    """Plain tables have no MERGE: Spark itself refuses, which shows that the statement was complete."""
    spark.sql("create table plain_target (id bigint, at bigint, v string) using parquet")
    stage = values(spark, 2, "s").withColumn("at", F.lit(1).cast("bigint"))
    for options in ({}, {"guard": "cursor", "cursor": "at"}):
        with pytest.raises(Exception, match="(?i)merge into table|UNSUPPORTED"):
            merge_into(stage, "plain_target", ["id"], **options)
    spark.sql("drop table plain_target")


def test_a_cut_sync_takes_few_jobs(spark, folder):
    window = Mode.window("2025-01-01", "2025-01-02")
    for connect in ({}, {"part_buckets": 4}):
        config = {"connect": {"root": f"{folder}/{len(connect)}", **connect}}
        spec = StreamSpec("t", "s", "id")
        SnapshotSink(spark, config).write(stage_dataset(dataset(Stream(spec, marked(spark, 500, "b0")))))
        group = f"sync{len(connect)}"
        spark.sparkContext.setJobGroup(group, group)
        staged = stage_dataset(dataset(Stream(spec, marked(spark, 100)), mode=window))
        sink = SnapshotSink(spark, {**config, "mode": window})
        sink.write(staged)
        sink.check(staged)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setJobGroup("", "")
        assert sink.target(staged.streams[0], staged).count() == 500
        assert len(jobs) <= 7, len(jobs)


@pytest.mark.parametrize("counted_above", [0, 1 << 40])
def test_parts_and_plain_table_agree(spark, folder, monkeypatch, counted_above):
    monkeypatch.setattr("tablesync.functions.sizing.SMALL_WRITE_BYTES", counted_above)
    monkeypatch.setattr("tablesync.sinks.snapshot.spread_for_write", partial(spread_for_write, rows_per_writer=5))
    plain, cut = SnapshotTable(spark, f"{folder}/a"), SnapshotTable(spark, f"{folder}/b", 4)
    base = spark.range(40).select("id", (F.col("id") % 7).alias("at"), F.lit("t").alias("v"))
    stages = [base.where("id % 3 = 0").withColumn("at", F.col("at") + 1).withColumn("v", F.lit("s")),
              spark.range(35, 60).select("id", F.lit(3).cast("bigint").alias("at"), F.lit("u").alias("v"))]
    for table in (plain, cut):
        table.replace(base, ["id"])
        for stage in stages:
            table.upsert(stage, ["id"], "at", guard="cursor")
    assert rows(plain.read()) == rows(cut.read())


def test_k18_q14_empty_streams(spark, folder):
    some, none = spark.range(3), spark.range(0)
    write_snapshot(some, folder)
    assert write_snapshot(none, folder, on_empty="skip").read().count() == 3
    assert write_snapshot(none, folder, incremental=True, keys=["id"]).read().count() == 3
    assert write_snapshot(none, folder).read().count() == 0


def test_k19_dry_run_leaves_the_target_alone(spark, folder):
    write_snapshot(spark.range(3), folder)
    write_snapshot(spark.range(9), folder, dry_run=True)
    assert SnapshotTable(spark, folder).read().count() == 3
    assert not Folder(spark, f"{folder}.trial").exists()


@pytest.mark.parametrize("kind", ["staging", "hive"])
def test_k19_trial_of_file_sinks(spark, folder, kind):
    config = {"connect": {"root": folder, "format": kind}}
    ObjectStoreSink(spark, config).write(dataset(Stream(SPEC, marked(spark))))
    trial = ObjectStoreSink(spark, {**config, "drop_after_complete": True})
    trial.write(dataset(Stream(SPEC, marked(spark, 99, "b2")), ctx=SyncContext.at("2025-01-10", "b2")))
    real = ObjectStoreSink(spark, config)
    assert real.target(Stream(SPEC, marked(spark)), dataset()).count() == 10
    assert not any("trial" in n for n in Folder(spark, folder).names())


def test_snapshot_sink_requires_keys_for_upserts(spark, folder):
    sink = SnapshotSink(spark, {"connect": {"root": folder}, "mode": Mode.window("2025-01-01", "2025-01-02")})
    with pytest.raises(StreamError):
        sink.write(dataset(Stream(StreamSpec("t"), spark.range(3), rows=3)))


def test_fixture_counts_of_a_tenant(spark, folder):
    """Full refresh 29 rows; the days bring 7, 7, 6 and 2; still 29 afterwards."""
    stream = {"schema": "fixture", "table": "transfer_test", "primary_field": "id", "cursor_field": "updated_at",
              "filters": {"customer_id": "Customer1"}, "drop_fields": ["customer_id"]}

    def sync(mode, dt_):
        config = {"mode": mode, "with": {"batch_id": True, "last_sync": True}, "streams": [stream], "dt": dt_}
        staged = stage_dataset(FixtureSource(spark, config).read())
        sink = get_destination(spark, "destination-snapshot", {"mode": mode, "connect": {"root": folder}})
        sink.write(staged)
        sink.check(staged)
        total = sink.target(staged.streams[0], staged).count()
        return staged.streams[0].rows, total

    assert sync(Mode.full(), "2025-02-01") == (29, 29)
    assert sync(Mode.full(), "2025-02-02") == (29, 29)
    for day, n in ((2, 7), (3, 7), (4, 6), (5, 2)):
        window = Mode.window(dt.datetime(2025, 1, day), dt.datetime(2025, 1, day + 1))
        assert sync(window, f"2025-02-{day + 1:02d}") == (n, 29)
    assert sync(Mode.window("2010-01-01", "2010-01-02"), "2025-03-01") == (0, 29)


# ---- K11, K12, L3, O10, E2


def test_k11_register_hive_table(spark, folder):
    write_hive(marked(spark), folder, SPEC, CTX)
    registered = register_table(spark, "leads_reg", hive_root(folder, SPEC), partitioned=True)
    assert registered.where("dt = date'2025-01-10'").count() == 10
    write_hive(marked(spark, 4, "b2"), folder, SPEC, SyncContext.at("2025-01-11", "b2"))
    assert register_table(spark, "leads_reg", hive_root(folder, SPEC), partitioned=True).count() == 14
    spark.sql("drop table leads_reg")


def test_k11_tables_that_own_their_data_are_not_replaced(spark, folder):
    path = write_staging(marked(spark), folder, "ns", SPEC, CTX)
    marked(spark, 3).write.mode("overwrite").saveAsTable("owned")
    with pytest.raises(DestinationError):
        register_table(spark, "owned", path)
    assert spark.table("owned").count() == 3
    spark.sql("drop table owned")


def test_k12_compound_store_and_catalog(spark, folder):
    config = {"connect": {"root": folder}}
    store = ObjectStoreSink(spark, config)
    compound = CompoundSink(spark, config, [store, CatalogSink(spark, {"connect": {"root": folder, "store": store}})])
    ds = stage_dataset(dataset(Stream(SPEC, marked(spark))))
    entities = list(compound.write(ds))
    assert [e.split(":")[0] for e in entities] == ["destination+object", "destination+catalog"]
    assert compound.check(ds) == {"crm.leads": 10}
    spark.sql("drop table default.crm__leads")


def test_k12_target_schema_and_order(spark, folder):
    seen = []

    class First(Sink):
        def write_stream(self, stream, dataset):
            seen.append(("first", stream.spec.qualified_name))

    class Second(First):
        def write_stream(self, stream, dataset):
            seen.append(("second", stream.spec.qualified_name))

    sink = multi_sink(First, Second)(spark, {"connect": {"target_schema": "out"}})
    sink.write(dataset(Stream(SPEC, marked(spark), rows=10)))
    assert seen == [("first", "out.leads"), ("second", "out.leads")]
    with pytest.raises(ValueError):
        CompoundSink(spark, {}, [])


def test_l3_console_prints_a_bounded_preview(spark, capsys):
    ConsoleSink(spark, {"connect": {"limit": 3}}).write(dataset(Stream(SPEC, spark.range(50))))
    text = capsys.readouterr().out
    assert "ns: crm.leads" in text and text.count("[") == 3


def test_p18_dataset_rename():
    ds = dataset(Stream(StreamSpec("a", "x"), None, 1))
    twice = ds.rename_stream("a", "x", "b", "y").rename_stream("b", "y", "c", "z")
    assert twice.stream("c").spec.qualified_name == "z.c" and twice.size(twice.stream("c")) == 1
    with pytest.raises(KeyError):
        ds.rename_stream("nope", "x", "b", "y")


def test_o10_e2_registry(spark):
    class Mine(Sink):
        pass

    register_sink("destination-mine", Mine, "mine")
    assert isinstance(get_destination(spark, get_destination_by_vendor("mine")), Mine)
    assert get_destination_by_vendor("console") == "destination-stdout"
    assert get_destination_by_vendor("postgresql") == "destination-postgres"


def test_e3_progress_subscribers(spark, folder):
    seen = []
    sink = ObjectStoreSink(spark, {"connect": {"root": folder}})
    sink.write(dataset(Stream(SPEC, marked(spark), rows=10)), lambda p: seen.append((p.processed, p.total)))
    assert seen[0] == (0, 10) and seen[-1] == (10, 10)
    json.dumps(sink.written)


def test_surplus_copies_are_expected_to_vanish(spark, folder):
    df = spark.range(30).select((F.col("id") % 20).alias("id"), F.lit("b1").alias("sync__batch_id"))
    spec = StreamSpec("t", "s", "id")
    sink = SnapshotSink(spark, {"connect": {"root": folder}})
    staged = stage_dataset(dataset(Stream(spec, df)))
    sink.write(staged)
    assert sink.check(staged) == {"s.t": 20}
    kept = SnapshotSink(spark, {"connect": {"root": f"{folder}/all", "dedupe": "none"}})
    kept.write(staged)
    assert kept.check(staged) == {"s.t": 30}
