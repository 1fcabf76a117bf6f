"""The run log: append-only events, and the queries over runs, progress and gaps.

One event per status change of a run. ``meta`` and ``output`` are JSON texts: meta
holds the execution id and the arguments of the run, output the progress entries
``{"progress": {entity: {"entity", "processed", "total", …}}}`` and an error cause.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.moments import wall_micros
from tablesync.operators.extract import column
from tablesync.operators.upsert import dedupe_latest
from tablesync.spec import Mode, as_utc
from tablesync.workspace import Folder

RUN_EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("transfer_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("meta", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("modified_at", T.TimestampType()),
    ]
)

RUNNING, SUCCESS, FAILURE = "RUNNING", "SUCCESS", "FAILURE"

#: Rows of a page, unless the caller asks for another number.
PAGE = 100

#: Event files of a transfer before they are gathered.
COMPACT_ABOVE = 200

_PLAIN_NAME = re.compile(r"[A-Za-z0-9_.-]+")

_ENTRY = "entity string, processed double, total double, rate_rps double, message string"
_OUTPUT = "progress map<string, string>"


# ---------------------------------------------------------------- writing and reading


def append_run_event(
    spark: SparkSession,
    path: str,
    run_id: str,
    transfer_id: str,
    status: str,
    meta: Mapping[str, Any],
    output: Mapping[str, Any] | None,
    created_at: datetime,
    modified_at: datetime,
) -> None:
    """Append one event; events are never changed, the newest one is the state of the run."""
    row = (
        run_id, transfer_id, status, json.dumps(meta),
        json.dumps(output) if output is not None else None,
        as_utc(created_at), as_utc(modified_at),
    )
    event = spark.createDataFrame([row], RUN_EVENT).coalesce(1)
    event.write.mode("append").partitionBy("transfer_id").parquet(path)


def compact_run_log(spark: SparkSession, path: str, transfer_id: str, above: int = COMPACT_ABOVE) -> int:
    """Gather a transfer's event files into one per month, if there are more than ``above``; returns the files left.

    The gathered events are written before the small files go. A crash between leaves some events
    twice, which no query over runs notices and the next compaction removes.
    """
    if not _PLAIN_NAME.fullmatch(transfer_id):
        return 0
    folder = Folder(spark, f"{path}/transfer_id={transfer_id}")
    files = [n for n in folder.names() if n.endswith(".parquet")]
    if len(files) <= above:
        return len(files)
    own = T.StructType([f for f in RUN_EVENT.fields if f.name != "transfer_id"])
    events = spark.read.schema(own).parquet(*[f"{folder.path}/{n}" for n in files]).distinct()
    month = F.date_format("created_at", "yyyy-MM")
    months = events.select(month.alias("m")).distinct().count()
    events.repartition(max(1, months), month).sortWithinPartitions("created_at").write.mode("append").parquet(folder.path)
    for name in files:
        folder.remove(name)
    return len([n for n in folder.names() if n.endswith(".parquet")])


def read_run_log(spark: SparkSession, path: str, transfer_id: str | None = None) -> DataFrame:
    """The events of all transfers or, without listing the others, of one; an absent log reads as empty."""
    folder = f"{path}/transfer_id={transfer_id}" if _PLAIN_NAME.fullmatch(transfer_id or "") else path
    if not Folder(spark, folder).exists():
        return spark.createDataFrame([], RUN_EVENT)
    events = spark.read.schema(RUN_EVENT).option("basePath", path).parquet(folder).select(*RUN_EVENT.names)
    return events if transfer_id is None else events.where(F.col("transfer_id") == transfer_id)


def current_runs(events: DataFrame) -> DataFrame:
    """The newest event of every run; a final status wins over RUNNING at the same moment."""
    final_first = F.when(F.col("status") == RUNNING, 1).otherwise(0)
    order = [F.col("modified_at").desc_nulls_last(), final_first.asc(), F.col("output").desc_nulls_last()]
    return dedupe_latest(events, ["run_id"], order=order)


# ---------------------------------------------------------------- listings


def execution_id(meta: Column) -> Column:
    return F.get_json_object(meta, "$.execution_id")


def latest_per_execution(runs: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Collapse retries: the most recently modified run of each execution.

    Ties keep the run a newest-first listing shows first. ``by`` names the columns
    that identify an execution; by default it is the execution id in ``meta``.
    """
    order = [F.col("modified_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("run_id").asc()]
    if by:
        return dedupe_latest(runs, by, order=order)
    tagged = runs.withColumn("execution_id", execution_id(F.col("meta")))
    return dedupe_latest(tagged, ["execution_id"], order=order)


def latest_run(runs: DataFrame, status: str | None = None) -> DataFrame:
    """The newest run of every transfer, optionally among the runs of one status."""
    chosen = runs if status is None else runs.where(F.col("status") == status)
    order = [F.col("created_at").desc_nulls_last(), F.col("run_id").asc()]
    return dedupe_latest(chosen, ["transfer_id"], order=order)


def latest_run_of(runs: DataFrame, transfer_id: str, status: str | None = None) -> DataFrame:
    """The newest run of one transfer (a top-1, not a sort of the log)."""
    chosen = runs.where(F.col("transfer_id") == transfer_id)
    if status is not None:
        chosen = chosen.where(F.col("status") == status)
    return chosen.orderBy(F.col("created_at").desc_nulls_last(), F.col("run_id")).limit(1)


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page of a listing, ``limit`` rows at most; ``order`` must end in a unique column."""
    if limit <= 0 or offset < 0:
        raise ValueError("offset must not be negative and limit must be positive")
    return df.orderBy(*order).offset(offset).limit(limit)


def list_runs(
    runs: DataFrame,
    transfers: DataFrame,
    destination_id: Any,
    execution: str | None = None,
    offset: int = 0,
    limit: int = PAGE,
) -> DataFrame:
    """Runs of one destination, newest first, optionally of one execution only."""
    mine = transfers.where(F.col("destination_id") == F.lit(destination_id)).select("transfer_id")
    listed = runs.join(mine, "transfer_id", "left_semi")
    if execution is not None:
        listed = listed.where(execution_id(F.col("meta")) == execution)
    return page(listed, [F.col("created_at").desc_nulls_last(), F.col("run_id").asc()], offset, limit)


def list_for_org(df: DataFrame, parent: DataFrame, key: str, organization_id: Any) -> DataFrame:
    """Rows of ``df`` whose parent (by ``key``) belongs to an organisation."""
    mine = parent.where(F.col("organization_id") == F.lit(organization_id)).select(key)
    return df.join(mine, key, "left_semi")


def distinct_sources(models: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """The sources a set of models needs, once each."""
    return models.select(*[column(c) for c in by]).distinct()


# ---------------------------------------------------------------- progress


def _entries(output: Column) -> Column:
    """The progress entries as an array; each is parsed by itself, so a malformed one spoils no other."""
    texts = F.map_values(F.from_json(output, _OUTPUT).getField("progress"))
    return F.transform(texts, lambda text: F.from_json(text, _ENTRY))


def _stream_of(entity: Column) -> Column:
    """What is moved, without the connector that moves it: the part after ``://``."""
    return F.when(entity.contains("://"), F.substring_index(entity, "://", -1)).otherwise(entity)


def rows_transferred(runs: DataFrame, compat: bool = False) -> DataFrame:
    """Rows each run wrote to its destination (``run_id``, ``rows_transferred``), without a shuffle.

    Only entries whose entity starts with ``destination`` count. A run without
    progress gives NULL, one with progress but nothing written gives 0. A compound
    sink reports the same rows once per sink: by default each stream counts with its
    largest report; ``compat=True`` sums all reports.
    """
    entries = F.col("__entries")
    written = F.filter(entries, lambda e: F.startswith(e["entity"], F.lit("destination")) & e["processed"].isNotNull())
    whole = F.transform(
        written,
        lambda e: F.struct(_stream_of(e["entity"]).alias("stream"), e["processed"].cast("bigint").alias("n")),
    )
    zero = F.lit(0).cast("bigint")
    if compat:
        total = F.aggregate(F.col("__done"), zero, lambda acc, e: acc + e["n"])
    else:
        def largest(stream: Column) -> Column:
            same = F.filter(F.col("__done"), lambda e: e["stream"] == stream)
            return F.array_max(F.transform(same, lambda e: e["n"]))

        streams = F.array_distinct(F.transform(F.col("__done"), lambda e: e["stream"]))
        total = F.aggregate(F.transform(streams, largest), zero, lambda acc, n: acc + n)
    known = F.coalesce(F.size(entries) > 0, F.lit(False))
    return (
        runs.select("run_id", _entries(F.col("output")).alias("__entries"))
        .select("run_id", "__entries", whole.alias("__done"))
        .select("run_id", F.when(known, total).alias("rows_transferred"))
    )


def percent(processed: Column, total: Column) -> Column:
    """Progress in percent with two digits; 0 while the total is 0 or unknown."""
    share = F.round(processed.cast("double") * 100.0 / total.cast("double"), 2)
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(share)


def progress_entries(runs: DataFrame) -> DataFrame:
    """One row per run and progress entity, with the percentage recomputed."""
    entries = runs.select("run_id", F.explode(_entries(F.col("output"))).alias("e"))
    return entries.select(
        "run_id",
        F.col("e.entity").alias("entity"),
        F.col("e.processed").cast("bigint").alias("processed"),
        F.col("e.total").cast("bigint").alias("total"),
        percent(F.col("e.processed"), F.col("e.total")).alias("percent"),
        F.col("e.message").alias("message"),
    )


def progress_summary(updates: DataFrame) -> DataFrame:
    """State of every (run, entity) after its last update: percent, rows per second, remaining seconds.

    ``updates`` holds ``run_id, entity, processed, total, at``. The rate compares the
    last two updates, so only two rows per entity survive the first shuffle.
    """
    by = ["run_id", "entity"]
    newest = Window.partitionBy(*by).orderBy(F.col("at").desc_nulls_last(), F.col("processed").desc_nulls_last())
    last_two = updates.withColumn("__rn", F.row_number().over(newest)).where("__rn <= 2")
    paired = last_two.withColumn("__processed", F.lead("processed").over(newest)).withColumn(
        "__at", F.lead("at").over(newest)
    )
    micros = wall_micros(F.col("at"), updates.schema["at"].dataType) - wall_micros(
        F.col("__at"), updates.schema["at"].dataType
    )
    rate = F.when(micros > 0, (F.col("processed") - F.col("__processed")) * 1e6 / micros).otherwise(F.lit(0.0))
    left = F.col("total") - F.col("processed")
    eta = F.when((F.col("__rate") > 0) & (F.coalesce("total", F.lit(0)) != 0), F.round(left / F.col("__rate"), 2))
    return (
        paired.where("__rn = 1")
        .withColumn("__rate", rate)
        .select(
            *by, "processed", "total",
            percent(F.col("processed"), F.col("total")).alias("percent"),
            F.round("__rate", 2).alias("rate_rps"),
            eta.alias("eta_seconds"),
        )
    )


# ---------------------------------------------------------------- gaps


def _slice(at: Column, kind: T.DataType, width: timedelta) -> Column:
    """Start of the time slice a moment lies in, in microseconds (exact integer arithmetic)."""
    micros = wall_micros(at, kind)
    return micros - F.pmod(micros, F.lit(width // timedelta(microseconds=1)))


def run_gaps(runs: DataFrame, lookback: timedelta, by: str = "transfer_id", at: str = "created_at") -> DataFrame:
    """Runs that started more than ``lookback`` after the run before (``by``, ``run_at``, ``prev_run``).

    Time is cut into slices as long as the lookback. Within a slice no two runs lie
    further apart than that, so only the first run of a slice can follow a gap, and
    the run before it is the last one of the previous slice. First and last are plain
    aggregates, combined map-side: a transfer with very many runs shrinks to one row
    per slice before anything is ordered.
    """
    slice_start = _slice(column(at), runs.schema[at].dataType, lookback)
    slices = (
        runs.where(column(at).isNotNull())
        .groupBy(column(by).alias(by), slice_start.alias("__slice"))
        .agg(F.min(column(at)).alias("run_at"), F.max(column(at)).alias("__last"))
    )
    before = F.lag("__last").over(Window.partitionBy(column(by)).orderBy("__slice"))
    return (
        slices.withColumn("prev_run", before)
        .where(F.col("prev_run") < F.col("run_at") - F.lit(lookback))
        .select(column(by), "run_at", "prev_run")
    )


def window_gaps(runs: DataFrame, by: str = "transfer_id", slice_width: timedelta = timedelta(days=1)) -> DataFrame:
    """Runs whose window starts after everything covered so far (``covered_until`` < ``window_start``).

    ``runs`` holds ``window_start`` and ``window_end`` (not before the start). Of runs
    with one start only the first can follow a gap, so they are aggregated map-side.
    The running maximum is split into slices of window start: the maxima of earlier
    slices are carried in by a join, so one group is one transfer's slice and not its
    whole history.
    """
    slice_start = _slice(F.col("window_start"), runs.schema["window_start"].dataType, slice_width)
    key = column(by)
    starts = runs.groupBy(key.alias(by), slice_start.alias("__slice"), "window_start").agg(
        F.min("window_end").alias("window_end"), F.max("window_end").alias("__end")
    )
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        starts.groupBy(key.alias(by), "__slice")
        .agg(F.max("__end").alias("__end"))
        .withColumn("__carry", F.max("__end").over(earlier))
        .drop("__end")
    )
    inside = Window.partitionBy(key, "__slice").orderBy("window_start")
    so_far = F.max("__end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        starts.join(carried, [by, "__slice"], "left")
        .withColumn("covered_until", F.greatest(so_far, F.col("__carry")))
        .where(F.col("covered_until") < F.col("window_start"))
        .select(key, "window_start", "window_end", "covered_until")
    )


def scheduled_gaps(runs: DataFrame, by: str = "transfer_id", slice_width: timedelta = timedelta(days=1)) -> DataFrame:
    """Runs whose window starts after what the last earlier success reached: ``run_id``, ``window_start``, ``reach``.

    ``runs`` holds ``run_id``, ``created_at``, ``window_start``, ``window_end`` and ``ok``. A run reaches its window's
    end, or its own start if that came first. The last success is a running maximum within a slice of time, and a
    maximum per slice carried into later ones, so one group is one transfer's slice and not its whole history.
    """
    kind = runs.schema["created_at"].dataType
    rows = runs.where(F.col("created_at").isNotNull()).withColumn("__us", wall_micros(F.col("created_at"), kind))
    reach = F.struct(F.col("__us").alias("us"), "run_id", F.least("window_end", "created_at").alias("reach"))
    rows = rows.withColumn("__done", F.when(F.col("ok"), reach)).withColumn("__slice", _slice(F.col("created_at"), kind, slice_width))
    inside = Window.partitionBy(column(by), "__slice").orderBy("__us").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(column(by)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(column(by).alias(by), "__slice").agg(F.max("__done").alias("__last"))
    slices = slices.select(column(by), "__slice", F.max("__last").over(earlier).alias("__carry"))
    last = F.coalesce(F.max("__done").over(inside), F.col("__carry"))
    found = rows.join(slices, [by, "__slice"], "left").withColumn("__before", last)
    found = found.withColumn("reach", F.col("__before.reach")).where(F.col("reach") < F.col("window_start"))
    return found.select(column(by), "run_id", "window_start", "reach")


def recorded_window_end(meta: Column) -> Column:
    """End of the window a run recorded in its arguments, if it did."""
    return F.try_to_timestamp(F.get_json_object(meta, "$.arguments.mode.end"))


def last_reach(runs: DataFrame, transfer_id: str) -> datetime | None:
    """How far the last successful run of a transfer copied: its recorded window end, if that lay behind it, or its start time.

    A run before its slot records an end in the future; rows after its start were not there yet. None before the first success. SUCCESS is final, so raw events serve as well as
    current states.
    """
    reach = F.least(recorded_window_end(F.col("meta")), F.col("created_at"))
    last = latest_run_of(runs, transfer_id, SUCCESS).select(F.unix_micros(reach)).first()
    return None if last is None else datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=last[0])


def starts_after(mode: Mode, reach: datetime | None) -> bool:
    """Does a window leave a hole after ``reach``? Full refreshes and first runs never do."""
    return mode.incremental and reach is not None and reach < mode.start


def has_run_gap(runs: DataFrame, transfer_id: str, mode: Mode) -> bool:
    """Does the window of a scheduled run start after the last successful run ended?"""
    return mode.incremental and starts_after(mode, last_reach(runs, transfer_id))
