"""The query catalogue: every operator run over the given tables, beside the SQL that defines its result.

Each entry is a function ``(spark, sf_dir) -> DataFrame``. Sinks are exercised by writing
to a fresh folder and reading back; the SQL states the content the target must have.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesync.functions import moments
from tablesync.functions.identifiers import safe_identifier_column
from tablesync.functions.types import build_schema, infer_json_schema, normalise, schemas_compatible
from tablesync.operators import fanout, integrity, runlog, schedule, upsert
from tablesync.operators.augment import augment, vectorised
from tablesync.operators.batches import BATCH, STREAM
from tablesync.operators.extract import extract, stream_count
from tablesync.plans.stage import stage_dataset
from tablesync.plans.transfer import SyncConfig, adhoc_mode, inspect_source, rerun, run_sync
from tablesync.sinks.catalog import register_table
from tablesync.sinks.compound import CompoundSink
from tablesync.sinks.console import preview
from tablesync.sinks.objectstore import ObjectStoreSink, hive_root, write_hive
from tablesync.sinks.snapshot import SnapshotSink, SnapshotTable
from tablesync.sources.datasource import JsonLines, PluginSource, register_data_source
from tablesync.sources.files import FileSource
from tablesync.sources.footers import file_footers, footer_counts
from tablesync.spec import DAILY, SIXHOURLY, Bookkeeping, Mode, ModelSpec, StreamSpec, SyncContext
from tablesync.streaming.progress import StreamProgress, observed_feed
from tablesync.streaming.upsert import file_feed, stream_append, stream_upsert
from tablesync.workspace import fresh_folder, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

EVENTS = StreamSpec("events", primary_field="event_id", cursor_field="ts")
ORDERS = StreamSpec("orders", primary_field="o_orderkey", cursor_field="o_orderdate")
CUSTOMER = StreamSpec("customer", primary_field="c_custkey")

RUN_TIME = datetime(2025, 1, 10)
WINDOW = Mode.window("2024-01-10", "2024-01-17")
DAY_AND_OVERLAP = timedelta(days=1, hours=3)

LINE_KEYS = ["l_orderkey", "l_linenumber"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL of its result."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def context(batch_id: str | None = None) -> SyncContext:
    return SyncContext.at(RUN_TIME, batch_id, timestamp_type="timestamp_ntz")


def file_source(spark: SparkSession, sf_dir: str, *specs: StreamSpec, mode: Mode = Mode.full(), **marks) -> FileSource:
    config = {"connect": {"root": sf_dir}, "streams": list(specs), "mode": mode, "with": marks, "context": context()}
    return FileSource(spark, config)


# ---------------------------------------------------------------- extract and augment


@query("""
SELECT event_id, ts, user_id, value, props, '1736467200000' AS sync__batch_id,
       TIMESTAMP '2025-01-10 00:00:00' AS sync__last_synced_at, DATE '2025-01-10' AS dt
FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17' AND event_type = 'purchase'
""")
def tenant_incremental_export(spark, sf_dir):
    """One tenant's window through stage and hive sink; the tenant column is dropped."""
    spec = StreamSpec("events", "", "event_id", "ts", {"event_type": "purchase"}, ("event_type",))
    dataset = file_source(spark, sf_dir, spec, mode=WINDOW, batch_id=True, last_sync=True).read()
    staged = stage_dataset(dataset)
    root = fresh_folder(spark, "hive")
    sink = ObjectStoreSink(spark, {"connect": {"root": root, "format": "hive"}, "mode": WINDOW})
    sink.write(staged)
    sink.check(staged)
    return spark.read.parquet(hive_root(root, spec)).drop(STREAM, BATCH)


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate
FROM orders WHERE o_orderpriority = '3-MEDIUM'
""")
def tenant_full_refresh(spark, sf_dir):
    """No cursor predicate on a full refresh; the tenant filter stays."""
    spec = StreamSpec("orders", "", "o_orderkey", "o_orderdate", {"o_orderpriority": "3-MEDIUM"}, ("o_orderpriority",))
    return file_source(spark, sf_dir, spec).read().stream("orders").df


@query("SELECT count(1) AS n FROM events WHERE ts >= TIMESTAMP '2010-01-01' AND ts < TIMESTAMP '2010-01-02'")
def empty_window(spark, sf_dir):
    """A window without rows keeps its schema and counts 0."""
    return stream_count(table(spark, sf_dir, "events"), EVENTS, Mode.window("2010-01-01", "2010-01-02"))


@query("SELECT count(1) AS n FROM customer WHERE c_mktsegment = CAST(NULL AS VARCHAR)")
def null_filter(spark, sf_dir):
    """Equality with NULL matches nothing."""
    spec = StreamSpec("customer", "", "c_custkey", filters={"c_mktsegment": None})
    return stream_count(table(spark, sf_dir, "customer"), spec)


@query("SELECT c_custkey, c_name, c_nationkey, 'acme' AS vendor, CAST(7 AS INTEGER) AS edition FROM customer")
def constant_columns(spark, sf_dir):
    """Constants of the configuration as columns of every row."""
    spec = StreamSpec("customer", "", "c_custkey", include_columns=("c_name", "c_nationkey"))
    config = {"connect": {"root": sf_dir}, "streams": [spec], "context": context(), "extra": {"vendor": ("string", "acme"), "edition": ("int", 7)}}
    return FileSource(spark, config).read().stream("customer").df


@query("""
SELECT o_custkey, sum(o_totalprice) AS total, count(1) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey HAVING count(1) > 1
""")
def query_stream(spark, sf_dir):
    """A stream that is a SQL query, with the filters of any stream on top of it."""
    text = f"SELECT o_orderpriority, o_custkey, sum(o_totalprice) AS total, count(1) AS n FROM parquet.`{sf_dir}/orders.parquet` GROUP BY ALL HAVING count(1) > 1"
    spec = StreamSpec("bills", "", "o_custkey", filters={"o_orderpriority": "1-URGENT"}, drop_fields=("o_orderpriority",), query=text)
    return file_source(spark, sf_dir, spec).read().stream("bills").df


#: Column, filter value, and the SQL of what the value is in the column's type.
_FILTERS = (
    ("nation", 7, "7"), ("nation", 7.0, "7"), ("nation", 7.5, "NULL"), ("nation", 2**40, "NULL"), ("nation", 2**70, "NULL"),
    ("nation", "7", "7"), ("nation", "abc", "NULL"), ("nation", True, "NULL"), ("nation", float("nan"), "NULL"),
    ("balance", 0.5, "0.5"), ("balance", 2**53 + 1, "NULL"), ("balance", "x", "NULL"),
    ("segment", "FURNITURE", "'FURNITURE'"), ("segment", 5, "'5'"),
    ("rich", True, "true"), ("rich", "false", "false"), ("rich", 1, "NULL"),
    ("day", "2024-01-08", "DATE '2024-01-08'"), ("day", "no day", "NULL"), ("day", 3, "NULL"),
)


@query(
    "WITH c AS (SELECT CAST(c_nationkey AS INTEGER) AS nation, CAST(c_custkey AS DOUBLE) / 2 AS balance, c_mktsegment AS segment,"
    " c_nationkey < 9 AS rich, DATE '2024-01-01' + CAST(c_nationkey AS INTEGER) AS day FROM customer) "
    + " UNION ALL ".join(f"SELECT {i} AS test, count(1) AS n FROM c WHERE {c} = {s}" for i, (c, _, s) in enumerate(_FILTERS))
)
def filter_types(spark, sf_dir):
    """Filter values that a column's type holds exactly, inexactly or not at all."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("int").alias("nation"), (F.col("c_custkey").cast("double") / 2).alias("balance"),
        F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") < 9).alias("rich"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey").cast("int")).alias("day"),
    )
    out = None
    for i, (name, value, _) in enumerate(_FILTERS):
        one = stream_count(rows, StreamSpec("customer", filters={name: value})).select(F.lit(i).alias("test"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_custkey, c_name, 'b1' AS sync__batch_id, '1.0.0' AS sync__version FROM customer")
def augment_constants(spark, sf_dir):
    spec = StreamSpec("customer", "", "c_custkey", include_columns=("c_name",))
    rows = extract(table(spark, sf_dir, "customer"), spec)
    return augment(rows, context("b1"), Bookkeeping(batch_id=True, version="1.0.0"))


@query("""
SELECT event_id, md5(CAST(event_id AS VARCHAR)
       || strftime(ts, '%Y-%m-%d %H:%M:%S')
       || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END
       || CAST(user_id AS VARCHAR) || coalesce(nullif(event_type, 'error'), 'None')
       || CAST(value AS VARCHAR) || props) AS sync__checksum
FROM events
""")
def row_checksum(spark, sf_dir):
    """MD5 over every raw column, before drops; NULL renders as the word None."""
    rows = table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("error")))
    others = [c for c in rows.columns if c != "event_id"]
    return augment(rows, context(), Bookkeeping(checksum=True), drop=others)


@query("""
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS l_quantity,
       CAST(CAST(l_discount AS DECIMAL(12, 2)) AS DOUBLE) AS l_discount,
       CAST(l_shipdate AS DATE) AS l_shipdate,
       CAST(json_object('flag', l_returnflag, 'status', l_linestatus) AS VARCHAR) AS flags
FROM lineitem
""")
def normalise_types(spark, sf_dir):
    """Integers and floats widen, decimals become doubles, structs become JSON, dates stay."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("float"), F.col("l_discount").cast("decimal(12,2)"),
        F.col("l_shipdate").cast("date"),
        F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias("flags"),
    )
    return normalise(rows, decimals="double", nested="json")


@query(r"""
SELECT DISTINCT p_name AS raw,
       substr(regexp_replace(regexp_replace('9' || p_name || '-' || p_brand, '\W+', '_', 'g'), '^[0-9]+', ''), 1, 64) AS safe
FROM part
""")
def sanitize_identifiers(spark, sf_dir):
    name = F.concat(F.lit("9"), F.col("p_name"), F.lit("-"), F.col("p_brand"))
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_name").alias("raw"), safe_identifier_column(name).alias("safe")).distinct()


@query("""
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
""")
def include_columns(spark, sf_dir):
    """Key, cursor and the requested column only; the window reaches the scan."""
    spec = StreamSpec("orders", "", "o_orderkey", "o_orderdate", include_columns=("o_totalprice",))
    rows = extract(table(spark, sf_dir, "orders"), spec, Mode.window("1997-01-01", "1998-01-01"))
    return rows.select("o_orderkey", "o_orderdate", "o_totalprice")


@query("""
SELECT event_type AS tenant, count(1) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17' GROUP BY event_type
""")
def stream_counts_by_tenant(spark, sf_dir):
    counted = stream_count(table(spark, sf_dir, "events"), EVENTS, WINDOW, by=["event_type"])
    return counted.withColumnRenamed("event_type", "tenant")


@query("""
SELECT count(1) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17' AND event_type = 'click'
""")
def stream_count_filtered(spark, sf_dir):
    spec = StreamSpec("events", "", "event_id", "ts", {"event_type": "click"})
    return stream_count(table(spark, sf_dir, "events"), spec, WINDOW)


@query("""
SELECT 'customer' AS stream, count(1) AS n FROM customer
UNION ALL SELECT 'orders', count(1) FROM orders UNION ALL SELECT 'events', count(1) FROM events
""")
def multi_stream_counts(spark, sf_dir):
    return file_source(spark, sf_dir, CUSTOMER, ORDERS, EVENTS).counts()


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_path, strftime(ts, '%Y_%m_%d') AS day_name,
       strftime(ts, '%Y%m%d%H%M%S') AS second_name, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS millis,
       ts - INTERVAL 27 HOUR AS window_start, date_trunc('second', ts) AS parsed,
       ts - INTERVAL 2 HOUR AS in_utc
FROM events
""")
def time_functions(spark, sf_dir):
    """Formats, epoch text, interval arithmetic, ISO parsing and zone conversion on a column."""
    events = table(spark, sf_dir, "events")
    ts, kind = F.col("ts"), events.schema["ts"].dataType
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return events.select(
        "event_id",
        F.date_format(ts, moments.DAY_PATH).alias("day_path"),
        F.date_format(ts, moments.DAY_NAME).alias("day_name"),
        F.date_format(ts, moments.SECOND_NAME).alias("second_name"),
        moments.epoch_millis_text(ts, kind).alias("millis"),
        (ts - F.lit(DAY_AND_OVERLAP)).alias("window_start"),
        moments.parse_iso(iso).cast("timestamp_ntz").alias("parsed"),
        moments.to_utc(ts, "+02:00").alias("in_utc"),
    )


@query("""
SELECT table_name AS stream_name, ordinal_position AS pos, column_name AS name,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
            WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
            ELSE data_type END AS type
FROM information_schema.columns
WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents',
                     'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
""")
def catalog_inspect(spark, sf_dir):
    """Streams and fields a source offers, one row per field."""
    fields = F.posexplode("fields").alias("pos", "field")
    found = file_source(spark, sf_dir).inspect().select("stream_name", fields)
    return found.select("stream_name", (F.col("pos") + 1).alias("pos"), "field.name", "field.type")


# ---------------------------------------------------------------- dedupe and upsert


def _event_values(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _from(day: str) -> Mode:
    return Mode.window(day, "9999-01-01")


def _until(day: str) -> Mode:
    return Mode.window("0001-01-01", day)


@query("""
WITH stage AS (SELECT event_id, ts, user_id, event_type, value + 1 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-18'),
     target AS (SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-20')
SELECT * FROM stage
UNION ALL SELECT t.* FROM target t WHERE NOT EXISTS (SELECT 1 FROM stage s WHERE s.event_id = t.event_id)
""")
def upsert_replace(spark, sf_dir):
    """Replace matched rows, add the others; both sides are windows of events."""
    events = _event_values(spark, sf_dir)
    target = extract(events, EVENTS, _until("2024-01-20"))
    stage = extract(events, EVENTS, _from("2024-01-18")).withColumn("value", F.col("value") + 1)
    return upsert.upsert_replace(target, stage, ["event_id"])


@query("""
SELECT event_id, ts, user_id, event_type, value + CASE WHEN ts >= TIMESTAMP '2024-01-18' THEN 1 ELSE 0 END AS value FROM events
""")
def upsert_idempotent(spark, sf_dir):
    """The same stage upserted twice into a snapshot table leaves its rows as after the first time."""
    events = _event_values(spark, sf_dir)
    target = SnapshotTable(spark, fresh_folder(spark, "idempotent"))
    target.replace(extract(events, EVENTS, _until("2024-01-20")))
    stage = extract(events, EVENTS, _from("2024-01-18")).withColumn("value", F.col("value") + 1)
    for _ in range(2):
        target.upsert(stage, ["event_id"], "ts")
    return target.read()


@query("""
SELECT event_id, ts, user_id, event_type, value + CASE WHEN ts >= TIMESTAMP '2024-01-18' THEN 1 ELSE 0 END AS value FROM events
""")
def upsert_after_crash(spark, sf_dir):
    """A run that is lost while it writes leaves no trace; the next upsert finds the rows of before."""
    events = _event_values(spark, sf_dir)
    target = SnapshotTable(spark, fresh_folder(spark, "crash"), 4)
    target.replace(extract(events, EVENTS, _until("2024-01-20")), ["event_id"])
    lost = extract(events, EVENTS, _until("2024-01-05")).withColumn("value", F.col("value") - 7)
    fails = F.when(F.col("event_id") % 97 == 0, F.raise_error(F.lit("the run was lost")).cast("double")).otherwise(F.col("value"))
    try:
        target.upsert(lost.withColumn("value", fails), ["event_id"], "ts", dedupe="none", on_disk=True, rows=10**9)
    except PySparkException:
        stage = extract(events, EVENTS, _from("2024-01-18")).withColumn("value", F.col("value") + 1)
        target.upsert(stage, ["event_id"], "ts")
    return target.read()


@query("""
WITH stage AS (SELECT event_id, ts + INTERVAL 40 DAY AS ts, user_id, event_type, value + 1 AS value
               FROM events WHERE ts >= TIMESTAMP '2024-01-18'),
     target AS (SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-20')
SELECT * FROM stage
UNION ALL SELECT t.* FROM target t WHERE NOT EXISTS (SELECT 1 FROM stage s WHERE s.event_id = t.event_id)
""")
def upsert_parts(spark, sf_dir):
    """A table in many parts rewrites those of staged keys; replaced rows move to another day."""
    events = _event_values(spark, sf_dir)
    target = SnapshotTable(spark, fresh_folder(spark, "parts"), 16)
    target.replace(extract(events, EVENTS, _until("2024-01-20")), ["event_id"])
    stage = extract(events, EVENTS, _from("2024-01-18")).withColumn("value", F.col("value") + 1)
    stage = stage.withColumn("ts", F.col("ts") + F.lit(timedelta(days=40)))
    target.upsert(stage, ["event_id"], "ts")
    return target.read()


@query("""
WITH stage AS (SELECT event_id, ts - to_hours(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS ts,
                      user_id, event_type, value + 1 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-18'),
     target AS (SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-20'),
     fresh AS (SELECT s.* FROM stage s LEFT JOIN target t ON s.event_id = t.event_id WHERE t.event_id IS NULL OR s.ts >= t.ts)
SELECT * FROM fresh
UNION ALL SELECT t.* FROM target t WHERE NOT EXISTS (SELECT 1 FROM fresh s WHERE s.event_id = t.event_id)
""")
def upsert_guarded(spark, sf_dir):
    """With the cursor guard a stage row older than its target row is ignored."""
    events = _event_values(spark, sf_dir)
    target = extract(events, EVENTS, _until("2024-01-20"))
    stage = extract(events, EVENTS, _from("2024-01-18")).withColumn("value", F.col("value") + 1)
    back = F.when(F.col("event_type") == "error", F.lit(timedelta(hours=1))).otherwise(F.lit(timedelta(0)))
    return upsert.upsert_replace(target, stage.withColumn("ts", F.col("ts") - back), ["event_id"], "cursor", "ts")


@query("""
WITH base AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_custkey END AS k, c_name, c_mktsegment FROM customer),
     stage AS (SELECT k, c_name, 'X' AS c_mktsegment FROM base WHERE k IS NULL OR c_mktsegment = 'FURNITURE')
SELECT CAST(k AS VARCHAR) AS k, c_name, c_mktsegment FROM (SELECT * FROM stage
UNION ALL SELECT b.* FROM base b WHERE NOT EXISTS (SELECT 1 FROM stage s WHERE s.k = b.k))
""")
def upsert_null_key(spark, sf_dir):
    """NULL keys never match, so the rows of both sides are kept; a fifth of all keys is NULL."""
    customer = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey"))
    base = customer.select(key.alias("k"), "c_name", "c_mktsegment")
    stage = base.where(F.col("k").isNull() | (F.col("c_mktsegment") == "FURNITURE"))
    merged = upsert.upsert_replace(base, stage.withColumn("c_mktsegment", F.lit("X")), ["k"])
    return merged.withColumn("k", F.col("k").cast("string"))


@query("""
WITH stage AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
     target AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')
SELECT * FROM stage
UNION ALL SELECT t.* FROM target t WHERE NOT EXISTS
  (SELECT 1 FROM stage s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
""")
def upsert_delete_insert(spark, sf_dir):
    """Repeated keys of the stage are kept."""
    spec = StreamSpec("lineitem", "", LINE_KEYS, "l_shipdate")
    lines = table(spark, sf_dir, "lineitem")
    target, stage = extract(lines, spec, _until("1998-01-01")), extract(lines, spec, _from("1998-01-01"))
    return upsert.upsert_delete_insert(target, stage, LINE_KEYS)


_LATEST_LINES = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1
"""


@query(_LATEST_LINES)
def dedupe_latest(spark, sf_dir):
    """One row per key: newest cursor, ties by all other columns in order."""
    return upsert.dedupe_latest(table(spark, sf_dir, "lineitem"), LINE_KEYS, "l_shipdate")


@query(_LATEST_LINES)
def dedupe_sparse(spark, sf_dir):
    """The same result by the path that moves only the rows of repeated keys."""
    return upsert.dedupe_sparse(table(spark, sf_dir, "lineitem"), LINE_KEYS, "l_shipdate")


@query("""
SELECT l_orderkey, l_linenumber, count(1) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(1) > 1
""")
def duplicate_keys(spark, sf_dir):
    """Keys a stage must not hold under the duplicate policy 'error'."""
    return upsert.duplicate_keys(table(spark, sf_dir, "lineitem"), LINE_KEYS)


@query("""
WITH s0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_linenumber,
              l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'),
     stage AS (SELECT l_orderkey AS k, l_extendedprice AS price FROM s0 WHERE rn = 1),
     target AS (SELECT o_orderkey AS k, o_totalprice AS price FROM orders)
SELECT k, price FROM stage
UNION ALL SELECT t.k, t.price FROM target t WHERE NOT EXISTS (SELECT 1 FROM stage s WHERE s.k = t.k)
""")
def upsert_dedupe(spark, sf_dir):
    """Deduplicate the stage by key, then replace."""
    spec = StreamSpec("lineitem", "", "l_orderkey", "l_shipdate")
    lines = extract(table(spark, sf_dir, "lineitem"), spec, _from("1999-01-01"))
    lines = lines.select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    stage = upsert.dedupe_latest(lines, ["l_orderkey"], "l_shipdate")
    stage = stage.select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("price"))
    target = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return upsert.upsert_replace(target, stage, ["k"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'FURNITURE'")
def full_refresh_replace(spark, sf_dir):
    """A second full refresh with a narrower schema wins entirely."""
    customer = table(spark, sf_dir, "customer")
    target = SnapshotTable(spark, fresh_folder(spark, "refresh"))
    target.replace(customer)
    target.replace(customer.where("c_mktsegment = 'FURNITURE'").select("c_custkey", "c_name"))
    return target.read()


# ---------------------------------------------------------------- whole runs


@query("""
SELECT event_id, ts, user_id, value, props,
       CASE WHEN ts >= TIMESTAMP '2024-01-19 03:30:00' AND ts < TIMESTAMP '2024-01-20 06:30:00'
            THEN '1705734000000' ELSE '1705725000000' END AS sync__batch_id
FROM events WHERE event_type = 'purchase'
""")
def transfer_runs(spark, sf_dir):
    """First run: full refresh. Second run: the daily window, upserted. Both logged and checked."""
    folder = fresh_folder(spark, "transfer")
    cfg = SyncConfig(
        "t1", "purchase",
        [ModelSpec("m1", "s1", "", "events", "event_id", "event_type", "ts")],
        {"s1": {"vendor_type": "files", "connection_info": {"root": sf_dir}}},
        {
            "vendor_type": "snapshot",
            "connection_info": {"root": f"{folder}/target"},
            "schedule": {"frequency": DAILY, "hour": 6, "minute": 30},
        },
        run_log=f"{folder}/runs",
    )
    for now in ("2024-01-20T04:30:00", "2024-01-20T07:00:00"):
        result = run_sync(spark, cfg, now=now)
        if not result.ok:
            raise RuntimeError(result.error)
    return SnapshotTable(spark, f"{folder}/target/events").read().drop("sync__last_synced_at")


def _purchases(sf_dir: str, folder: str) -> SyncConfig:
    return SyncConfig(
        "t1", "purchase",
        [ModelSpec("m1", "s1", "", "events", "event_id", "event_type", "ts")],
        {"s1": {"vendor_type": "files", "connection_info": {"root": sf_dir}}},
        {
            "vendor_type": "snapshot",
            "connection_info": {"root": f"{folder}/target"},
            "schedule": {"frequency": DAILY, "hour": 6, "minute": 30},
        },
        run_log=f"{folder}/runs",
    )


def _must(result):
    if not result.ok:
        raise RuntimeError(result.error)
    return result


@query("""
SELECT event_id, ts, user_id, value, props,
       ts >= TIMESTAMP '2024-01-19 03:30:00' AND ts < TIMESTAMP '2024-01-20 06:30:00' AS again
FROM events WHERE event_type = 'purchase'
""")
def rerun_window(spark, sf_dir):
    """A recorded run repeated: its window is copied again, under a new batch id, and nothing else changes."""
    cfg = _purchases(sf_dir, fresh_folder(spark, "rerun"))
    _must(run_sync(spark, cfg, now="2024-01-20T04:30:00"))
    second = _must(run_sync(spark, cfg, now="2024-01-20T07:00:00"))
    _must(rerun(spark, cfg, second.run_id, now="2024-01-20T09:00:00"))
    rows = SnapshotTable(spark, f"{cfg.destination['connection_info']['root']}/events").read()
    again = F.col("sync__batch_id") == SyncContext.at("2024-01-20T09:00:00").batch_id
    return rows.withColumn("again", again).drop("sync__batch_id", "sync__last_synced_at")


@query("""
SELECT 'SUCCESS' AS status, n AS rows_transferred, 1 AS n_runs FROM (SELECT count(1) AS n FROM events WHERE event_type = 'purchase')
UNION ALL SELECT 'SUCCESS', n, 1 FROM (SELECT count(1) AS n FROM events WHERE event_type = 'purchase'
  AND ts >= TIMESTAMP '2024-01-19 03:30:00' AND ts < TIMESTAMP '2024-01-20 06:30:00')
UNION ALL SELECT 'FAILURE', NULL, 1
""")
def run_states(spark, sf_dir):
    """States of three runs in the log: a backfill, an increment, and one whose source is gone."""
    folder = fresh_folder(spark, "states")
    cfg = _purchases(sf_dir, folder)
    for now in ("2024-01-20T04:30:00", "2024-01-20T07:00:00"):
        _must(run_sync(spark, cfg, now=now))
    run_sync(spark, _purchases(f"{folder}/nowhere", folder), now="2024-01-20T08:00:00")
    runs = runlog.current_runs(runlog.read_run_log(spark, cfg.run_log))
    counts = runs.join(runlog.rows_transferred(runs), "run_id").select("status", "rows_transferred", F.lit(1).alias("n_runs"))
    return counts.withColumn("rows_transferred", F.when(F.col("status") == "SUCCESS", F.col("rows_transferred")))


@query("""
SELECT 'customer' AS stream, c_custkey AS k FROM customer WHERE c_mktsegment = 'FURNITURE'
UNION ALL SELECT 'bills', o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'FURNITURE'
""")
def two_source_transfer(spark, sf_dir):
    """One transfer whose models come from two sources."""
    folder = fresh_folder(spark, "sources")
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    table(spark, sf_dir, "orders").join(owner, "o_custkey").write.parquet(f"{folder}/second/bills.parquet")
    cfg = SyncConfig(
        "t2", "FURNITURE",
        [ModelSpec("m1", "s1", "", "customer", "c_custkey", "c_mktsegment"), ModelSpec("m2", "s2", "", "bills", "o_orderkey", "c_mktsegment")],
        {
            "s1": {"vendor_type": "files", "connection_info": {"root": sf_dir}},
            "s2": {"vendor_type": "files", "connection_info": {"root": f"{folder}/second"}},
        },
        {"vendor_type": "snapshot", "connection_info": {"root": f"{folder}/target"}},
    )
    _must(run_sync(spark, cfg, now="2024-01-20T04:30:00"))
    keys = {"customer": "c_custkey", "bills": "o_orderkey"}
    found = [SnapshotTable(spark, f"{folder}/target/{t}").read().select(F.lit(t).alias("stream"), F.col(k).alias("k")) for t, k in keys.items()]
    return found[0].unionByName(found[1])


@query("""
SELECT c.c_mktsegment AS tenant_id, o.o_orderkey, o.o_totalprice
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def tenant_fanout(spark, sf_dir):
    """Every recipient's export in one pass, written as one folder per tenant."""
    customer = table(spark, sf_dir, "customer")
    segment = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    fact = table(spark, sf_dir, "orders").join(segment, "o_custkey")
    recipients = customer.select(F.col("c_mktsegment").alias("tenant_id")).distinct()
    spec = StreamSpec("orders", "", "o_orderkey", include_columns=("o_totalprice", "segment"))
    rows = fanout.tenant_rows(fact, recipients, spec, "segment", ctx=context())
    root = fanout.export_all_tenants(rows, fresh_folder(spark, "fanout"), spec, context())
    return spark.read.parquet(root).select("tenant_id", "o_orderkey", "o_totalprice")


@query("""
SELECT c_mktsegment AS tenant_id, 'customer' AS stream, c_custkey AS id FROM customer WHERE c_mktsegment <> 'FURNITURE'
UNION ALL SELECT c_mktsegment, 'debtor', c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE'
""")
def fanout_two_streams(spark, sf_dir):
    """Two streams of equally many rows exported to one root in one batch, each of them twice: a folder holds all rows of both."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    recipients = customer.select(F.col("c_mktsegment").alias("tenant_id")).where("tenant_id <> 'FURNITURE'").distinct()
    root = fresh_folder(spark, "fanout-two")
    for name in ("customer", "debtor") * 2:
        spec = StreamSpec(name, "", "id")
        rows = fanout.tenant_rows(customer, recipients, spec, "c_mktsegment", ctx=context())
        fanout.export_all_tenants(rows, root, spec, context())
    return spark.read.parquet(root).select("tenant_id", F.regexp_replace(STREAM, "-.*", "").alias("stream"), "id")


@query("""
SELECT sink, o_orderkey, o_totalprice FROM (VALUES ('staging'), ('hive')) AS s(sink) CROSS JOIN orders
""")
def multi_sink_counts(spark, sf_dir):
    """A compound sink: the staged rows reach every sink."""
    staged = stage_dataset(file_source(spark, sf_dir, ORDERS, batch_id=True).read())
    root = fresh_folder(spark, "compound")
    kinds = ("staging", "hive")
    sinks = [ObjectStoreSink(spark, {"connect": {"root": f"{root}/{k}", "format": k}}) for k in kinds]
    compound = CompoundSink(spark, {}, sinks)
    compound.write(staged)
    compound.check(staged)
    stream = staged.stream("orders")
    found = [s.target(stream, staged).select(F.lit(k).alias("sink"), "o_orderkey", "o_totalprice") for k, s in zip(kinds, sinks)]
    return found[0].unionByName(found[1])


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders
           WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
     m AS (SELECT min(n) AS n FROM (SELECT max(rn) AS n FROM r GROUP BY o_orderpriority))
SELECT o_orderkey, o_orderpriority, o_totalprice FROM r WHERE rn <= (SELECT n FROM m)
""")
def hive_two_schemas(spark, sf_dir):
    """Two schemas with one table name and equally many rows, in one batch: the folder they share holds all rows.

    The first run is lost after it wrote a part of one stream, and a second time before it began the other.
    """
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    ranked = orders.withColumn("rn", rank)
    least = ranked.groupBy("o_orderpriority").agg(F.max("rn").alias("n")).agg(F.min("n").alias("n"))
    chosen = ranked.join(F.broadcast(least), F.col("rn") <= F.col("n")).select("o_orderkey", "o_orderpriority", "o_totalprice")
    root = fresh_folder(spark, "schemas")
    for schema, priority in (("urgent", "1-URGENT"), ("high", "2-HIGH")):
        chosen.where(F.col("o_orderpriority") == priority).write.parquet(f"{root}/source/{schema}/orders.parquet")
    specs = [StreamSpec("orders", schema, "o_orderkey") for schema in ("urgent", "high")]
    dataset = file_source(spark, f"{root}/source", *specs, batch_id=True).read()
    lost = dataset.stream("orders", "urgent").df
    write_hive(lost.where("o_orderkey % 2 = 0"), f"{root}/target", specs[0], dataset.ctx, namespace=dataset.namespace)
    write_hive(lost, f"{root}/target", specs[0], dataset.ctx, namespace=dataset.namespace)
    for _ in range(2):  # the batch again adds nothing
        sink = ObjectStoreSink(spark, {"connect": {"root": f"{root}/target", "format": "hive"}})
        sink.write(dataset)
        sink.check(dataset)
    return spark.read.parquet(hive_root(f"{root}/target", specs[0])).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT count(1) AS n, least(1000, count(1)) AS most FROM orders")
def rows_per_file(spark, sf_dir):
    """No file has more rows than the batch size; together they have all."""
    staged = stage_dataset(file_source(spark, sf_dir, ORDERS).read())
    sink = ObjectStoreSink(spark, {"connect": {"root": fresh_folder(spark, "files")}, "batch_size": 1000})
    sink.write(staged)
    files = sink.target(staged.stream("orders"), staged).groupBy(F.input_file_name().alias("file"))
    files = files.agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.sum("n").alias("n"), F.max("n").alias("most"))


@query("""
SELECT on_empty, CASE WHEN on_empty = 'skip' THEN n ELSE 0 END AS n
FROM (VALUES ('skip'), ('replace')) AS v(on_empty) CROSS JOIN (SELECT count(1) AS n FROM customer)
""")
def empty_refresh(spark, sf_dir):
    """A full refresh without rows empties the target, unless it is told to skip."""
    out = None
    for policy in ("skip", "replace"):
        connect = {"root": fresh_folder(spark, "empty"), "on_empty": policy}
        full = stage_dataset(file_source(spark, sf_dir, CUSTOMER).read())
        none = stage_dataset(file_source(spark, sf_dir, StreamSpec("customer", "", "c_custkey", filters={"c_custkey": -1})).read())
        for dataset in (full, none):
            SnapshotSink(spark, {"connect": connect}).write(dataset)
        target = SnapshotSink(spark, {"connect": connect}).target(full.stream("customer"), full)
        one = target.agg(F.count(F.lit(1)).alias("n")).select(F.lit(policy).alias("on_empty"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT sink, c_custkey, c_name FROM (VALUES ('snapshot'), ('hive')) AS s(sink) CROSS JOIN customer WHERE c_nationkey < 12
""")
def trial_leaves_target(spark, sf_dir):
    """A trial run loads other rows beside the target and drops them; the target keeps its own."""
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    root = fresh_folder(spark, "trial")
    source.where("c_nationkey < 12").write.parquet(f"{root}/real/customer.parquet")
    source.where("c_nationkey >= 12").write.parquet(f"{root}/other/customer.parquet")
    out = None
    for kind, make in (("snapshot", SnapshotSink), ("hive", ObjectStoreSink)):
        connect = {"root": f"{root}/{kind}", "format": "hive"}
        real = stage_dataset(file_source(spark, f"{root}/real", CUSTOMER, batch_id=True).read())
        make(spark, {"connect": connect}).write(real)
        other = stage_dataset(file_source(spark, f"{root}/other", CUSTOMER, batch_id=True).read())
        make(spark, {"connect": connect, "drop_after_complete": True}).write(other)
        rows = make(spark, {"connect": connect}).target(real.stream("customer"), real)
        one = rows.select(F.lit(kind).alias("sink"), "c_custkey", "c_name")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderpriority, count(1) AS n, DATE '2025-01-10' AS dt FROM orders GROUP BY o_orderpriority")
def catalog_table(spark, sf_dir):
    """A hive layout registered in the catalog and queried as a table."""
    root = fresh_folder(spark, "catalog")
    path = write_hive(table(spark, sf_dir, "orders"), root, ORDERS, context())
    name = f"orders_{uuid.uuid4().hex}"
    registered = register_table(spark, name, path, partitioned=True)
    counts = written(registered.groupBy("o_orderpriority", "dt").agg(F.count(F.lit(1)).alias("n")), "catalog-counts")
    spark.sql(f"DROP TABLE {name}")
    return counts


@query("""
SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def streaming_upsert(spark, sf_dir):
    """Three feeds, the newest first: late rows must not overwrite newer ones."""
    folder = fresh_folder(spark, "stream")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    target = SnapshotTable(spark, f"{folder}/target", 8)
    slices = (_from("2024-01-21"), Mode.window("2024-01-11", "2024-01-21"), _until("2024-01-11"))
    for window in slices:
        extract(rows, EVENTS, window).write.mode("append").parquet(f"{folder}/feed")
        feed = file_feed(spark, f"{folder}/feed", rows.schema)
        run = stream_upsert(feed, target, ["user_id"], "ts", f"{folder}/checkpoint")
        run.awaitTermination()
    return target.read()


@query("""
SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def streaming_replay(spark, sf_dir):
    """The whole feed again, in the order it came and with no memory of the first time: the target stays as it is."""
    folder = fresh_folder(spark, "replay")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    target = SnapshotTable(spark, f"{folder}/target", 4)
    for window in (_from("2024-01-16"), _until("2024-01-16")):
        extract(rows, EVENTS, window).write.mode("append").parquet(f"{folder}/feed")
    for attempt in range(2):
        feed = file_feed(spark, f"{folder}/feed", rows.schema)
        stream_upsert(feed, target, ["user_id"], "ts", f"{folder}/checkpoint-{attempt}").awaitTermination()
    return target.read()


@query("SELECT event_id, ts, event_type FROM events ORDER BY event_id LIMIT 100")
def console_preview(spark, sf_dir):
    """The first rows under a stated order (a top-k)."""
    return preview(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), 100, ["event_id"])


# ---------------------------------------------------------------- connectors of one's own, footers, inference


@query("""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, '7' AS sync__version FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1998-01-01'
""")
def plugin_source(spark, sf_dir):
    """Orders written and read by a Python data source of the library, behind the source contract: filter, window, bookkeeping."""
    root = fresh_folder(spark, "plugin")
    orders = table(spark, sf_dir, "orders").drop("o_orderpriority")
    name = register_data_source(spark, JsonLines)
    orders.write.format(name).mode("overwrite").option("path", f"{root}/orders").option("compression", "gzip").save()
    spec = StreamSpec("orders", "", "o_orderkey", "o_orderdate", {"o_orderstatus": "F"}, ("o_orderstatus",))
    connect = {"format": name, "root": root, "schemas": {"orders": orders.schema}}
    config = {"connect": connect, "streams": [spec], "mode": Mode.window("1996-03-01", "1998-01-01"), "context": context(), "with": {"version": "7"}}
    return PluginSource(spark, config).read().stream("orders").df


@query("""
SELECT 'orders' AS stream, count(1) AS n, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders
UNION ALL SELECT 'customer', count(1), min(c_custkey), max(c_custkey) FROM customer
UNION ALL SELECT 'lineitem', count(1), min(l_orderkey), max(l_orderkey) FROM lineitem
""")
def counts_from_footers(spark, sf_dir):
    """Unfiltered counts and key bounds of three tables, answered by the statistics of their row groups."""
    out = None
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("lineitem", "l_orderkey")):
        n, least, most = footer_counts(spark, f"{sf_dir}/{name}.parquet", key).first()
        one = spark.createDataFrame([(name, n, least, most)], "stream string, n long, least long, most long")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT codec, count(1) AS n FROM (VALUES ('UNCOMPRESSED'), ('SNAPPY'), ('ZSTD')) AS c(codec) CROSS JOIN orders GROUP BY codec
""")
def file_codecs(spark, sf_dir):
    """Rows per codec, as the footers of the written files tell."""
    staged = stage_dataset(file_source(spark, sf_dir, ORDERS).read())
    out = None
    for codec in ("none", "snappy", "zstd"):
        sink = ObjectStoreSink(spark, {"connect": {"root": fresh_folder(spark, codec)}, "parquet": {"compression": codec}, "batch_size": 5000})
        sink.write(staged)
        files = file_footers(spark, sink.path(staged.stream("orders"), staged)).select(F.explode("codecs").alias("codec"), "n_rows")
        one = files.groupBy("codec").agg(F.sum("n_rows").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS priority, o_totalprice AS price,
       CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 0.5 END AS mixed, o_orderstatus AS status
FROM orders
""")
def schema_from_all_rows(spark, sf_dir):
    """Columns inferred from JSON texts of all rows: one is null in two of three rows, one is whole here and broken there, one is nested."""
    third = F.col("o_orderkey") % 3 == 0
    mixed = F.when(third, F.col("o_custkey").cast("string")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
    head = F.to_json(F.struct(
        F.col("o_orderkey").alias("k"), F.when(third, F.col("o_orderpriority")).alias("priority"), F.col("o_totalprice").alias("price"),
        F.struct(F.col("o_orderstatus").alias("status")).alias("inner"),
    ))
    texts = table(spark, sf_dir, "orders").select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "mixed": '), mixed, F.lit("}")).alias("j"))
    rows = texts.select(F.from_json("j", infer_json_schema(texts, "j")).alias("r")).select("r.*")
    return rows.select("k", "priority", "price", "mixed", "inner.status")


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def computed_by_batches(spark, sf_dir):
    """A computed field that Column functions cannot express, texts without accents, by pandas over Arrow batches."""
    spec = StreamSpec("documents", "", "doc_id", include_columns=("text",), drop_fields=("text",))
    plain = vectorised(lambda s: s.str.normalize("NFD").str.replace("[\u0300-\u036f]", "", regex=True).str.normalize("NFC"), "string", "text")
    config = {"connect": {"root": sf_dir}, "streams": [spec], "context": context(), "extra": {"plain": plain}}
    return FileSource(spark, config).read().stream("documents").df


@query("SELECT event_id, ts, user_id, DATE_TRUNC('day', ts)::DATE AS dt FROM events")
def streaming_append(spark, sf_dir):
    """Two overlapping halves, the later days first, appended with the keys of both as state: a restart goes on from its checkpoint."""
    folder = fresh_folder(spark, "append")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    for window in (_from("2024-01-10"), _until("2024-01-20")):
        extract(rows, EVENTS, window).write.mode("append").parquet(f"{folder}/feed")
        feed = file_feed(spark, f"{folder}/feed", rows.schema).withColumn("ts", F.col("ts").cast("timestamp"))
        stream_append(feed, f"{folder}/target", ["event_id"], "ts", "60 days", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/target").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
WITH b AS (SELECT CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 864000) AS BIGINT) AS batch, count(1) AS n FROM events GROUP BY ALL)
SELECT batch, n AS n_rows, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS processed FROM b
""")
def stream_progress(spark, sf_dir):
    """Observations of a running stream: the events of ten days are one file and one micro-batch, counted on their way."""
    folder, heard = fresh_folder(spark, "progress"), []
    rows = table(spark, sf_dir, "events")
    for start in ("2024-01-01", "2024-01-11", "2024-01-21"):
        window = Mode.window(start, datetime.fromisoformat(start) + timedelta(days=10))
        extract(rows, EVENTS, window).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    progress = StreamProgress("events", lambda p: heard.append((p.processed, p.message)))
    spark.streams.addListener(progress)
    try:
        feed = observed_feed(file_feed(spark, f"{folder}/feed", rows.schema, maxFilesPerTrigger=1))
        writer = feed.writeStream.format("parquet").option("path", f"{folder}/target").option("checkpointLocation", f"{folder}/checkpoint")
        batches = progress.watch(writer.trigger(availableNow=True).start())
    finally:
        spark.streams.removeListener(progress)
    found = [(i, batches[b], p) for i, (b, (p, _)) in enumerate(zip(sorted(batches), heard, strict=True))]
    return spark.createDataFrame(found, "batch long, n_rows long, processed long")


@query("SELECT c_custkey, c_name, c_nationkey, 'clients' AS stream FROM customer")
def renamed_stream(spark, sf_dir):
    """A stream written under another name and schema."""
    dataset = file_source(spark, sf_dir, StreamSpec("customer", "", "c_custkey", include_columns=("c_name", "c_nationkey"))).read()
    renamed = dataset.rename_stream("customer", "", "clients", "crm")
    connect = {"root": fresh_folder(spark, "renamed")}
    SnapshotSink(spark, {"connect": connect}).write(stage_dataset(renamed))
    return spark.read.parquet(f"{connect['root']}/crm/clients").select("c_custkey", "c_name", "c_nationkey", F.lit("clients").alias("stream"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_totalprice > 100000 AS large FROM orders")
def declared_schema(spark, sf_dir):
    """A text file read by declared types."""
    folder = fresh_folder(spark, "declared")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_totalprice") > 100000).alias("large"))
    orders.write.option("header", "false").csv(f"{folder}/orders")
    schema = build_schema([("o_orderkey", int), ("o_orderstatus", str), ("o_totalprice", float), ("large", bool)])
    connect = {"root": folder, "format": "csv", "schemas": {"orders": schema}}
    return FileSource(spark, {"connect": connect, "streams": [StreamSpec("orders", "", "o_orderkey")], "context": context()}).read().stream("orders").df


@query("SELECT event_id, ts, user_id, value, props FROM events WHERE ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-20' AND event_type = 'purchase'")
def adhoc_run(spark, sf_dir):
    """A run outside its schedule: one day back from a moment, into an empty target."""
    folder = fresh_folder(spark, "adhoc")
    mode = adhoc_mode(end="2024-01-20", start="2024-01-19")
    _must(run_sync(spark, _purchases(sf_dir, folder), mode, now="2024-01-20T04:30:00"))
    return SnapshotTable(spark, f"{folder}/target/events").read().select("event_id", "ts", "user_id", "value", "props")


@query("SELECT 'orders' AS stream_name, column_name AS name FROM (DESCRIBE orders) UNION ALL SELECT 'nation', column_name FROM (DESCRIBE nation)")
def inspect_job(spark, sf_dir):
    """The job that tells what a source offers."""
    found = inspect_source(spark, {"vendor_type": "files", "connection_info": {"root": sf_dir}})
    return found.where(F.col("stream_name").isin("orders", "nation")).select("stream_name", F.explode("fields.name").alias("name"))


# ---------------------------------------------------------------- checks


@query("""
SELECT case_name, compatible, CASE WHEN compatible THEN n ELSE 0 END AS admitted
FROM (VALUES ('same', true), ('reordered', true), ('int_vs_bigint', true), ('missing', false), ('extra', false),
             ('retyped', false)) AS v(case_name, compatible) CROSS JOIN (SELECT count(1) AS n FROM customer)
""")
def schema_compat(spark, sf_dir):
    """Verdict per stage variant against the target's schema, and how many rows may load."""
    target = table(spark, sf_dir, "customer")
    cases = {
        "same": target,
        "reordered": target.select(*reversed(target.columns)),
        "int_vs_bigint": target.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint")),
        "missing": target.drop("c_acctbal"),
        "extra": target.withColumn("c_comment", F.lit("x")),
        "retyped": target.withColumn("c_acctbal", F.col("c_acctbal").cast("string")),
    }
    out = None
    for name, stage in cases.items():
        fits = schemas_compatible(stage.schema, target.schema)
        admitted = stage if fits else stage.limit(0)
        one = admitted.agg(F.count(F.lit(1)).alias("admitted"))
        one = one.select(F.lit(name).alias("case_name"), F.lit(fits).alias("compatible"), "admitted")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH b AS (SELECT strftime(ts, '%Y%m%d') AS batch_id, count(1) AS n,
             count(1) FILTER (WHERE ts < TIMESTAMP '2024-01-15' OR ts >= TIMESTAMP '2024-01-16' + INTERVAL 12 HOUR) AS kept
           FROM events GROUP BY 1)
SELECT batch_id, kept AS loaded, n AS expected, kept = n AS ok FROM b
""")
def batch_volume(spark, sf_dir):
    """Staged against loaded rows per batch; a batch is a cursor day here, of which the target lost one and a half."""
    staged = table(spark, sf_dir, "events").withColumn("sync__batch_id", F.date_format("ts", "yyyyMMdd"))
    lost = "ts >= timestamp_ntz'2024-01-15 00:00:00' and ts < timestamp_ntz'2024-01-16 12:00:00'"
    target = written(staged.where(f"not ({lost})"), "volume")
    return integrity.batch_volumes(target, staged)


@query("""
SELECT count(1) AS orphans FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderpriority <> '3-MEDIUM')
""")
def referential_check(spark, sf_dir):
    """Lines whose order is missing, with the orders of one priority taken away."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderpriority <> '3-MEDIUM'")
    return integrity.check_referential(lines, orders, {"l_orderkey": "o_orderkey"})


@query("""
SELECT event_type AS tenant, count(1) AS n FROM events WHERE event_type NOT IN ('purchase', 'signup') GROUP BY event_type
""")
def tenant_leak(spark, sf_dir):
    """Rows an export for two tenants must not contain."""
    leaked = integrity.foreign_rows(table(spark, sf_dir, "events"), "event_type", ["purchase", "signup"])
    return leaked.groupBy(F.col("event_type").alias("tenant")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- run log


def _runs(spark, sf_dir) -> DataFrame:
    """Events seen as runs: one transfer per user, errors are failures, props is the meta JSON."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("transfer_id"),
        F.when(failed, runlog.FAILURE).otherwise(runlog.SUCCESS).alias("status"),
        F.col("props").alias("meta"),
        F.col("event_type"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("modified_at"),
    )


def _k(meta: str = "props"):
    return F.get_json_object(meta, "$.k").cast("bigint")


def _run_outputs(spark, sf_dir) -> DataFrame:
    """A run per user whose progress JSON has one entry per event type and connector.

    Clicks are written by a compound sink, so two destination entries report them.
    """
    per_type = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(_k()).alias("processed"))
    connectors = (
        F.when(F.col("event_type") == "click", F.array(F.lit("destination+object"), F.lit("destination+catalog")))
        .when(F.col("event_type").isin("purchase", "signup"), F.array(F.lit("destination+object")))
        .otherwise(F.array(F.lit("source+files")))
    )
    reports = per_type.withColumn("connector", F.explode(connectors)).withColumn(
        "entity", F.concat(F.col("connector"), F.lit("://ns/"), F.col("event_type"))
    )
    entry = F.struct(F.col("entity"), F.struct("entity", "processed"))
    output = F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("progress")))
    return reports.groupBy(F.col("user_id").alias("run_id")).agg(output.alias("output"))


@query("""
SELECT user_id AS run_id, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT))
         FILTER (WHERE event_type IN ('purchase', 'signup', 'click')), 0) AS BIGINT) AS rows_transferred
FROM events GROUP BY user_id
""")
def rows_transferred(spark, sf_dir):
    """Rows written per run from its progress JSON; a stream two sinks report counts once."""
    return runlog.rows_transferred(_run_outputs(spark, sf_dir))


@query("""
SELECT user_id AS run_id, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)
         * CASE WHEN event_type = 'click' THEN 2 ELSE 1 END)
         FILTER (WHERE event_type IN ('purchase', 'signup', 'click')), 0) AS BIGINT) AS rows_transferred
FROM events GROUP BY user_id
""")
def rows_transferred_compat(spark, sf_dir):
    """The plain sum over all destination entries."""
    return runlog.rows_transferred(_run_outputs(spark, sf_dir), compat=True)


@query("""
WITH u AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events),
     n AS (SELECT *, row_number() OVER w AS rn, lead(k) OVER w AS k0, lead(us) OVER w AS us0 FROM u
           WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us DESC, k DESC)),
     r AS (SELECT *, CASE WHEN us > us0 THEN (k - k0) * CAST(1000000 AS DOUBLE) / (us - us0) ELSE 0.0 END AS rate
           FROM n WHERE rn = 1)
SELECT user_id AS run_id, event_type AS entity, k AS processed, CAST(100 AS BIGINT) AS total,
       round(k * CAST(100 AS DOUBLE) / 100, 2) AS percent, round(rate, 2) + 0.0 AS rate_rps,
       CASE WHEN rate > 0 THEN round((100 - k) / rate, 2) END AS eta_seconds FROM r
""")
def progress_summary(spark, sf_dir):
    """Percent, rate and remaining time after the last of many updates per run and entity."""
    updates = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("entity"), _k().alias("processed"),
        F.lit(100).cast("bigint").alias("total"), F.col("ts").alias("at"),
    )
    return runlog.progress_summary(updates)


@query("""
SELECT user_id AS run_id, count(1) AS total, count(1) FILTER (WHERE event_type = 'purchase') AS processed,
       round(100.0 * CAST(count(1) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / count(1), 2) AS percent
FROM events GROUP BY user_id
""")
def progress_entries(spark, sf_dir):
    """Progress entries unpacked from the output JSON of every run."""
    per_run = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("processed")
    )
    entry = F.struct(F.lit("source+files://ns/events").alias("entity"), "processed", "total")
    output = F.to_json(F.struct(F.create_map(F.lit("source+files://ns/events"), entry).alias("progress")))
    runs = per_run.select("run_id", output.alias("output"))
    return runlog.progress_entries(runs).select("run_id", "total", "processed", "percent")


@query("""
SELECT DISTINCT o.o_custkey, c.c_nationkey AS source_id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def distinct_sources(spark, sf_dir):
    """Keys are reduced before the join, so a hot key joins once."""
    used = runlog.distinct_sources(table(spark, sf_dir, "orders"), ["o_custkey"])
    owner = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source_id")
    )
    return runlog.distinct_sources(used.join(owner, "o_custkey"), ["o_custkey", "source_id"])


@query("""
SELECT e.event_id, e.ts, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k
FROM events e JOIN customer c ON e.user_id = c.c_custkey
WHERE c.c_mktsegment = 'FURNITURE' ORDER BY e.ts DESC, e.event_id LIMIT 100 OFFSET 20
""")
def run_listing(spark, sf_dir):
    """One page of the runs of a destination, newest first."""
    transfers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("transfer_id"), F.col("c_mktsegment").alias("destination_id")
    )
    listed = runlog.list_runs(_runs(spark, sf_dir), transfers, "FURNITURE", offset=20, limit=100)
    return listed.select(F.col("run_id").alias("event_id"), F.col("created_at").alias("ts"), _k("meta").alias("k"))


@query("""
SELECT c.c_custkey, c.c_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2
""")
def list_for_org(spark, sf_dir):
    """Rows whose parent belongs to an organisation; nations stand for parents, regions for organisations."""
    parents = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("organization_id")
    )
    return runlog.list_for_org(table(spark, sf_dir, "customer"), parents, "c_nationkey", 2).select("c_custkey", "c_name")


@query("""
SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1
""")
def latest_run_per_execution(spark, sf_dir):
    """Retries of an execution collapse to the newest; an execution is a user and event type here."""
    latest = runlog.latest_per_execution(_runs(spark, sf_dir), by=["transfer_id", "event_type"])
    return latest.select(
        F.col("transfer_id").alias("user_id"), "event_type", F.col("run_id").alias("event_id"),
        F.col("created_at").alias("ts"),
    )


@query("""
SELECT user_id, event_id, ts AS last_run FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1
""")
def latest_run(spark, sf_dir):
    """The newest successful run of every transfer."""
    latest = runlog.latest_run(_runs(spark, sf_dir), runlog.SUCCESS)
    return latest.select(
        F.col("transfer_id").alias("user_id"), F.col("run_id").alias("event_id"), F.col("created_at").alias("last_run")
    )


@query("""
SELECT user_id, ts AS run_at, prev AS prev_run FROM (SELECT user_id, ts, event_id,
  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
WHERE prev < ts - INTERVAL 27 HOUR
""")
def run_gaps(spark, sf_dir):
    """Runs whose predecessor lies before the start of their daily window."""
    return runlog.run_gaps(table(spark, sf_dir, "events"), DAY_AND_OVERLAP, by="user_id", at="ts")


@query("""
WITH r AS (SELECT user_id, ts AS window_start, ts + to_hours(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS window_end FROM events),
     c AS (SELECT *, max(window_end) OVER (PARTITION BY user_id ORDER BY window_start, window_end
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_until FROM r)
SELECT * FROM c WHERE covered_until < window_start
""")
def window_gaps(spark, sf_dir):
    """Recorded windows that leave a hole after everything covered so far."""
    hours = F.make_dt_interval(F.lit(0), _k().cast("int"))
    runs = table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").alias("window_start"), (F.col("ts") + hours).alias("window_end")
    )
    return runlog.window_gaps(runs, by="user_id")


@query("""
WITH r AS (SELECT user_id, event_id, event_type, ts, epoch_us(ts) AS us, date_trunc('day', ts) + INTERVAL 390 MINUTE AS we,
                  date_trunc('day', ts) + INTERVAL 390 MINUTE - INTERVAL 27 HOUR AS ws FROM events),
     s AS (SELECT user_id, us, least(we, ts) AS reach, event_id FROM r WHERE event_type <> 'error'),
     l AS (SELECT r.user_id, r.event_id, arg_max(s.reach, (s.us, s.event_id)) AS reach
           FROM r JOIN s ON s.user_id = r.user_id AND s.us < r.us GROUP BY 1, 2)
SELECT r.user_id, r.event_id, r.ws AS window_start, l.reach FROM r JOIN l ON l.user_id = r.user_id AND l.event_id = r.event_id
WHERE l.reach < r.ws
""")
def scheduled_gaps(spark, sf_dir):
    """Runs whose daily window starts after what the last success copied: its window's end, or its start if that was earlier."""
    runs = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("run_id"), "ts", (F.col("event_type") != "error").alias("ok")
    )
    runs = schedule.with_windows(runs, "ts", DAILY, 6, 30, prefix="window_").withColumnRenamed("ts", "created_at")
    gaps = runlog.scheduled_gaps(runs, by="user_id")
    return gaps.select("user_id", F.col("run_id").alias("event_id"), "window_start", "reach")


# ---------------------------------------------------------------- schedule


@query("""
SELECT event_id, date_trunc('day', ts) + INTERVAL 390 MINUTE AS daily_end,
       date_trunc('day', ts) + INTERVAL 390 MINUTE - INTERVAL 27 HOUR AS daily_start,
       date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 6) * 6 AS BIGINT)) AS six_end,
       date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 6) * 6 AS BIGINT)) - INTERVAL 390 MINUTE AS six_start
FROM events
""")
def schedule_windows(spark, sf_dir):
    """Daily slot at 06:30 and six-hourly slots, with their lookback."""
    runs = table(spark, sf_dir, "events").select("event_id", "ts")
    runs = schedule.with_windows(runs, "ts", DAILY, 6, 30, prefix="daily_")
    return schedule.with_windows(runs, "ts", SIXHOURLY, prefix="six_").drop("ts")


@query("""
SELECT event_id, abs(epoch_us(ts) - epoch_us(date_trunc('day', ts) + INTERVAL 390 MINUTE)) >= 10800000000 AS drifted FROM events
""")
def schedule_drift(spark, sf_dir):
    """Runs three hours or more away from the daily slot."""
    runs = table(spark, sf_dir, "events").select("event_id", "ts")
    return schedule.with_drift(runs, "ts", DAILY, 6, 30).drop("ts")
