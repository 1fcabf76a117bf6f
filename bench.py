"""Headline syncs and operators at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every entry does its whole work: syncs write and check their target, operators compute
all rows and columns into Spark's no-op sink. Session start is not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.operators import runlog
from tablesync.plans import catalogue
from tablesync.plans.stage import stage_dataset
from tablesync.sinks import get_destination
from tablesync.sources import get_source
from tablesync.spec import Mode
from tablesync.workspace import configure, fresh_folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: Every entry runs this often; the best time counts, as the first run also compiles.
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

MARKS = {"batch_id": True, "last_sync": True}

#: The reference claims one million rows per minute for a whole sync.
BASELINE_ROWS_PER_SECOND = 16_700


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tablesync-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def full_sync(spark: SparkSession, table: str, key, cursor: str, vendor: str, **connect) -> int:
    """Read a table, write it to a sink, check the volume; returns the rows moved."""
    stream = {"table": table, "primary_field": key, "cursor_field": cursor}
    source = get_source(spark, "source-files", {"connect": {"root": SF_DIR}, "streams": [stream], "with": MARKS})
    sink = get_destination(spark, vendor, {"connect": {"root": fresh_folder(spark, "bench"), **connect}})
    dataset = source.read()
    if not sink.single_pass:
        dataset = stage_dataset(dataset)
    sink.write(dataset)
    return sum(sink.check(dataset).values())


class Upsert:
    """A full target and the window that holds the newest tenth of the cursor range."""

    def __init__(self, spark: SparkSession, table: str, key, cursor: str, **connect):
        self.spark, self.connect = spark, {"root": fresh_folder(spark, "bench-target"), **connect}
        self.stream = {"table": table, "primary_field": key, "cursor_field": cursor}
        low, high = spark.read.parquet(f"{SF_DIR}/{table}.parquet").agg(F.min(cursor), F.max(cursor)).first()
        self.window = Mode.window(high - (high - low) * 0.1, high + timedelta(microseconds=1))
        full = self._read(Mode.full(), datetime(2025, 1, 10))
        self._sink(Mode.full()).write(full)
        self.rows = self._sink(Mode.full()).target(full.streams[0], full).count()

    def _read(self, mode: Mode, at: datetime):
        config = {"connect": {"root": SF_DIR}, "streams": [self.stream], "mode": mode, "dt": at, "with": MARKS}
        return stage_dataset(get_source(self.spark, "source-files", config).read())

    def _sink(self, mode: Mode):
        return get_destination(self.spark, "destination-snapshot", {"connect": self.connect, "mode": mode})

    def run(self) -> int:
        """Read the window, stage it, upsert it, check the volume; returns the rows staged."""
        staged = self._read(self.window, datetime.now())
        sink = self._sink(self.window)
        sink.write(staged)
        sink.check(staged)
        return staged.streams[0].rows

    def verify(self) -> None:
        stream = self._read(self.window, datetime.now()).streams[0]
        if self._sink(self.window).table(stream).read().count() != self.rows:
            raise RuntimeError("an upsert of rows the target holds changed their number")


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}
    rates: dict[str, float] = {}

    shuffled: dict[str, int] = {}
    totals = spark.sparkContext._jsc.sc().statusStore().executorSummary

    def timed(name: str, work: Callable[[], int | None]) -> None:
        best = None
        for _ in range(REPEATS):
            bytes_before, start = totals("driver").totalShuffleWrite(), time.perf_counter()
            rows = work()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
            shuffled[name] = totals("driver").totalShuffleWrite() - bytes_before
        seconds[name] = round(best, 3)
        if rows:
            rates[name] = round(rows / best)

    consume(spark.read.parquet(f"{SF_DIR}/lineitem.parquet"))  # start executors, load classes

    lines = ["l_orderkey", "l_linenumber"]
    timed("full_refresh_hive_lineitem", lambda: full_sync(spark, "lineitem", lines, "l_shipdate", "destination-files", format="hive"))
    timed("full_refresh_staging_lineitem", lambda: full_sync(spark, "lineitem", lines, "l_shipdate", "destination-files"))
    timed("full_refresh_snapshot_lineitem", lambda: full_sync(spark, "lineitem", lines, "l_shipdate", "destination-snapshot"))
    timed("full_refresh_snapshot_orders", lambda: full_sync(spark, "orders", "o_orderkey", "o_orderdate", "destination-snapshot"))
    targets = (("orders", "o_orderkey", "o_orderdate"), ("events", "event_id", "ts"), ("lineitem", lines, "l_shipdate"))
    for table, key, cursor in targets:
        pattern = "yyyy-MM-dd" if table == "events" else "yyyy"
        for kind, connect in (("plain", {}), ("parts", {"part_buckets": 8})):
            target = Upsert(spark, table, key, cursor, **connect)
            timed(f"incremental_{kind}_{table}", target.run)
            target.verify()

    written = {
        "tenant_incremental_export", "transfer_runs", "tenant_fanout", "multi_sink_counts", "streaming_upsert", "upsert_idempotent",
    }
    computed = {
        "row_checksum", "normalise_types", "upsert_replace", "upsert_guarded", "upsert_delete_insert", "upsert_null_key",
        "dedupe_latest", "dedupe_sparse", "upsert_dedupe", "batch_volume", "referential_check", "rows_transferred",
        "progress_summary", "run_listing", "latest_run_per_execution", "latest_run", "run_gaps", "window_gaps",
        "schedule_windows", "stream_counts_by_tenant",
    }
    for name, query in catalogue.QUERIES.items():
        if name in written | computed:
            timed(name, lambda: consume(query(spark, SF_DIR)))

    staged_log = fresh_folder(spark, "bench-log")
    timed("run_log_event", lambda: runlog.append_run_event(
        spark, staged_log, "r", "t", "RUNNING", {}, None, datetime(2025, 1, 1), datetime(2025, 1, 1)))

    print(json.dumps({
        "metric": "total wall time of headline syncs and operators",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_second": rates,
        "shuffle_bytes": shuffled,
        "repeats": REPEATS,
        "sync_rate_vs_baseline": {name: round(rate / BASELINE_ROWS_PER_SECOND, 2) for name, rate in rates.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    sys.exit(main())
