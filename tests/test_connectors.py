"""Python data sources, footers, inference over all rows, vectorised fields, live progress, appends with state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tablesync import get_source
from tablesync.functions.types import infer_json_schema
from tablesync.operators.augment import BATCH, augment, vectorised
from tablesync.progress import percent
from tablesync.sources.datasource import FilePartition, JsonLines, JsonLinesReader, register_data_source
from tablesync.sources.footers import file_footers, footer_counts
from tablesync.spec import Mode, StreamSpec, SyncContext
from tablesync.streaming.progress import StreamProgress, observed_feed
from tablesync.streaming.upsert import file_feed, stream_append
from tablesync.workspace import Folder, fresh_folder

SCHEMA = "id long, name string, score double, at timestamp_ntz, ok boolean"


@pytest.fixture
def folder(spark):
    return fresh_folder(spark, "connector")


def people(spark, n=40):
    at = F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))")
    name = F.when(F.col("id") % 5 > 0, F.concat(F.lit("né "), F.col("id")))
    return spark.range(n).select("id", name.alias("name"), (F.col("id") / 4).alias("score"), at.alias("at"), (F.col("id") % 2 == 0).alias("ok"))


def lines(spark, folder, df, name="t", mode="append", **options):
    df.write.format(register_data_source(spark, JsonLines)).mode(mode).options(**options).option("path", f"{folder}/{name}").save()
    return spark.read.format("tablesync-jsonl").schema(SCHEMA).option("path", f"{folder}/{name}").load()


# ---- E2: a connector as a Python data source


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_e2_round_trip(spark, folder, compression):
    df = people(spark).repartition(3)
    back = lines(spark, folder, df, compression=compression)
    assert rows(back) == rows(df) and back.rdd.getNumPartitions() == 3
    assert lines(spark, folder, people(spark, 3), compression=compression).count() == 43
    assert lines(spark, folder, people(spark, 2), mode="overwrite", compression=compression).count() == 2


def test_e2_filters_reach_the_reader_and_rows_agree(spark, folder):
    back, df = lines(spark, folder, people(spark).repartition(2)), people(spark)
    for where in (
        "id > 7 and id <= 30", "name = 'né 12'", "name is null and ok", "id in (1, 5, 9)", "score >= 2.5", "at < timestamp_ntz'2025-01-01 09:00:00'",
        "not (id = 3)", "name is not null and id = 500", "id > 3 or name is null",
    ):
        assert rows(back.where(where)) == rows(df.where(where)), where
    assert back.count() == 40, "no filter of an earlier plan is left"


def test_e2_the_reader_applies_the_streams_filters(spark, folder):
    df = people(spark).repartition(2)
    lines(spark, folder, df)
    schema = T._parse_datatype_string(SCHEMA)

    def read(*filters):
        reader = JsonLinesReader(schema, f"{folder}/t", filters)
        return sorted(i for p in reader.partitions() for b in reader.read(p) for i in b.column("id").to_pylist())

    assert read(("id", ">=", 37), ("ok", "=", True)) == [38]
    assert read(("name", "=", "né 12")) == [12] and read(("name", "<", "a")) == [], "NULL meets no filter"
    assert len(read(("id", "=", "7"), ("score", ">", 9), ("at", "=", "x"), ("ok", "=", 1))) == 40, "other types are left to Spark"


def test_e2_a_lost_write_leaves_nothing(spark, folder):
    lines(spark, folder, people(spark, 5))
    failing = people(spark).repartition(4).withColumn("score", F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        lines(spark, folder, failing, mode="overwrite")
    assert spark.read.format("tablesync-jsonl").schema(SCHEMA).option("path", f"{folder}/t").load().count() == 5
    assert all(n.startswith("part-") for n in Folder(spark, f"{folder}/t").names() if not n.startswith("."))


def test_e2_empty_tables_and_blank_lines(spark, folder):
    assert lines(spark, folder, people(spark, 0)).count() == 0
    schema = T.StructType([T.StructField("id", T.LongType())])
    reader = JsonLinesReader(schema, f"{folder}/nowhere")
    assert list(reader.read(reader.partitions()[0])) == [] and reader.partitions() == [FilePartition("")]


def test_e2_behind_the_source_contract(spark, folder):
    lines(spark, folder, people(spark))
    connect = {"format": JsonLines, "root": folder, "schemas": {"t": T._parse_datatype_string(SCHEMA)}}
    spec = StreamSpec("t", "", "id", "at", {"ok": True}, ("ok",))
    window = Mode.window(dt.datetime(2025, 1, 1, 10), dt.datetime(2025, 1, 1, 20))
    source = get_source(spark, "source-plugin", {"connect": connect, "streams": [spec], "mode": window})
    got = source.read().stream("t").df
    assert got.columns == ["id", "name", "score", "at"] and sorted(r.id for r in got.collect()) == [10, 12, 14, 16, 18]
    assert source.counts().first().n == 5 and source.inspect().first().stream_name == "t"


# ---- S12, A1, K9, K10: footers


def test_s12_counts_are_pushed_into_the_footers(spark, folder):
    people(spark).withColumn("day", F.to_date("at")).repartition(3).write.parquet(f"{folder}/t")
    found = footer_counts(spark, f"{folder}/t", "id", "score", "day")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id), MIN(score), MAX(score), MIN(day), MAX(day)]" in plan
    assert tuple(found.first()) == (40, 0, 39, 0.0, 9.75, dt.date(2025, 1, 1), dt.date(2025, 1, 2))
    texts = footer_counts(spark, f"{folder}/t", "name")
    assert "PushedAggregation: []" in texts._jdf.queryExecution().executedPlan().toString() and texts.first()[0] == 40
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList", "parquet"), "settings are put back"
    assert footer_counts(spark, f"{folder}/t").first().n == 40


def test_s12_footers_of_empty_tables(spark, folder):
    people(spark, 0).write.parquet(f"{folder}/t")
    assert tuple(footer_counts(spark, f"{folder}/t", "id").first()) == (0, None, None)


def test_k9_k10_files_tell_codec_and_rows(spark, folder):
    for codec in ("none", "snappy", "gzip", "zstd"):
        people(spark, 100).coalesce(1).write.option("compression", codec).option("maxRecordsPerFile", 40).parquet(f"{folder}/{codec}/day=1")
    found = file_footers(spark, folder)
    assert rows(found.select(F.explode("codecs"), "n_rows")) == sorted(
        [(c, n) for c in ("UNCOMPRESSED", "SNAPPY", "GZIP", "ZSTD") for n in (40, 40, 20)], key=str)
    assert found.where("row_groups <> 1").count() == 0


# ---- P16: inference over all rows


def inferred(spark, *texts):
    return infer_json_schema(spark.createDataFrame([(t,) for t in texts], "j string").repartition(3), "j").simpleString()


def test_p16_later_rows_decide(spark):
    assert inferred(spark, '{"a": null, "b": 1}', '{"a": "x"}', '{"c": {"d": null}}', '{"c": {"d": [1, 2.5]}}') == (
        "struct<a:string,b:bigint,c:struct<d:array<double>>>")
    assert inferred(spark, '{"a": 1}', '{"a": 1.5}', '{"a": 1e300}') == "struct<a:double>"
    assert inferred(spark, '{"a": 1}', '{"a": "x"}', '{"b": null}') == "struct<a:string,b:string>"


def test_p16_what_is_no_object(spark):
    assert inferred(spark) == "struct<>"
    assert inferred(spark, None, "", "no json", "[1]", "7") == "struct<>"
    assert inferred(spark, None, "{", '{"a": true}', "[1]") == "struct<a:boolean>"


# ---- P8, E1: a vectorised field


def test_e1_batches_beside_columns(spark):
    df = spark.createDataFrame([(1, "é", 2.0), (2, None, 3.0), (3, "", None)], "id long, s string, x double")
    extra = {
        "plain": vectorised(lambda s: s.str.normalize("NFD").str.encode("ascii", "ignore").str.decode("ascii"), "string", "s"),
        "both": vectorised(lambda i, x: i + x, "double", "id", "x"), "twice": lambda raw: F.col("id") * 2, "k": ("string", "c"),
    }
    got = augment(df, SyncContext.at("2025-01-10"), extra=extra, drop=["s"])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 2.0, "e", 3.0, 2, "c"), (2, 3.0, None, 5.0, 4, "c"), (3, None, "", None, 6, "c")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_e1_batches_are_bounded(spark):
    """Rows and bytes that ``fn`` gets at once, whatever a task holds."""
    names = list(BATCH)
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, most in BATCH.items():
            spark.conf.set(n, str(most * 100))
        size = vectorised(lambda s: s.str.len().sum() + 0 * s.str.len(), "long", "s")
        rows = vectorised(lambda s: len(s) + 0 * s.str.len(), "long", "s")
        df = spark.range(0, 6000, 1, 1).withColumn("s", F.expr("repeat('x', if(id < 5000, 10, 50000))"))
        got = augment(df, SyncContext.at("2025-01-10"), extra={"bytes": size, "rows": rows}, drop=["s"]).agg(F.max("bytes"), F.max("rows"), F.count("id")).first()
        assert got[0] <= BATCH[names[1]] + 50000 and got[1] <= BATCH[names[0]] and got[2] == 6000
        assert [int(spark.conf.get(n).rstrip("bB")) for n in names] == list(BATCH.values())
        spark.conf.set(names[0], "10")
        augment(df, SyncContext.at("2025-01-10"), extra={"rows": rows})
        assert spark.conf.get(names[0]) == "10"
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_e1_batches_are_let_go(spark):
    """A worker holds the texts of a few batches, not of all that it has read."""

    def alive(s):
        import gc

        s.str.len()
        held = [x for x in gc.get_objects() if type(x) is type(s) and x.name == s.name]
        return 0 * s.str.len() + len(held)

    df = spark.range(0, 20_000, 1, 1).withColumn("s", F.repeat(F.lit("x"), 10))
    held = augment(df, SyncContext.at("2025-01-10"), extra={"n": vectorised(alive, "long", "s")}).agg(F.max("n")).first()[0]
    assert 0 < held <= 8


# ---- E3, A4, X2: streams


EVENTS = "k long, at timestamp, v string"


def feed_of(spark, folder, *batches, **options):
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    return file_feed(spark, f"{folder}/feed", T._parse_datatype_string(EVENTS), **options)


def at(day, minute=0):
    return dt.datetime(2025, 1, day, 0, minute)


def test_e3_every_micro_batch_is_an_observation(spark, folder):
    heard = []
    progress = StreamProgress("feed", heard.append, total=6)
    spark.streams.addListener(progress)
    try:
        for batches, known in (([[(1, at(1), "a")], [(2, at(1), "b"), (3, at(1), "c")]], {0: 1, 1: 2}), ([[(4, at(2), "d")] * 3], {0: 1, 1: 2, 2: 3})):
            feed = observed_feed(feed_of(spark, folder, *batches, maxFilesPerTrigger=1))
            writer = feed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            assert progress.watch(writer.trigger(availableNow=True).start()) == known
    finally:
        spark.streams.removeListener(progress)
    assert [(p.processed, p.total, p.entity) for p in heard] == [(1, 6, "feed"), (3, 6, "feed"), (6, 6, "feed")]
    assert percent(heard[-1]) == 100.0 and heard[-1].before.processed == 3


def appended(spark, folder, feed, delay="1 day"):
    stream_append(feed, f"{folder}/target", ["k"], "at", delay, f"{folder}/checkpoint").awaitTermination()
    return sorted((r.k, r.v) for r in spark.read.parquet(f"{folder}/target").collect())


def test_x2_keys_are_known_after_a_restart(spark, folder):
    assert appended(spark, folder, feed_of(spark, folder, [(1, at(5), "a"), (1, at(5, 1), "again"), (2, at(5, 2), "b")])) in (
        [(1, "a"), (2, "b")], [(1, "again"), (2, "b")])
    first = appended(spark, folder, feed_of(spark, folder, [(1, at(5, 3), "late copy"), (3, at(4, 30), "late, in time"), (4, at(6), "c")]))
    assert [k for k, _ in first] == [1, 2, 3, 4] and ("late copy" not in dict(first).values())


def test_x2_rows_behind_the_watermark_go(spark, folder):
    appended(spark, folder, feed_of(spark, folder, [(1, at(5), "a")]))
    appended(spark, folder, feed_of(spark, folder, [(2, at(9), "b")]))
    assert appended(spark, folder, feed_of(spark, folder, [(3, at(2), "too late"), (4, at(9, 5), "c")])) == [(1, "a"), (2, "b"), (4, "c")]
