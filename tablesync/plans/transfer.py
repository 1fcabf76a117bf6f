"""A transfer from configuration to run log: resolve, read, stage, write, check, record."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.errors import RunGapDetected
from tablesync.operators import runlog
from tablesync.operators.schedule import drifted, window_for
from tablesync.plans.stage import drop_stage, stage_dataset
from tablesync.progress import Listener, Progress
from tablesync.sinks import Sink, get_destination, get_destination_by_vendor
from tablesync.sinks.base import refuse_shared_targets
from tablesync.sources import get_source, get_source_by_vendor
from tablesync.sources.fixture import STREAM as FIXTURE_STREAM
from tablesync.spec import (
    DAILY, INCREMENTAL, TRANSFER_BOOKKEEPING, Bookkeeping, Mode, ModelSpec, SyncContext, as_utc,
)
from tablesync.workspace import fresh_folder


@dataclass(frozen=True)
class SyncConfig:
    """Everything one transfer needs.

    ``sources`` maps source ids to ``{"vendor_type", "connection_info"}``, ``destination``
    has the same two entries and a ``schedule``. ``run_log`` is the folder of the run log.
    """

    transfer_id: str
    tenant_id: Any
    models: Sequence[ModelSpec]
    sources: Mapping[str, Mapping[str, Any]]
    destination: Mapping[str, Any]
    run_log: str | None = None
    bookkeeping: Bookkeeping = TRANSFER_BOOKKEEPING
    parallel: int = 4
    types: Mapping[str, Any] = field(default_factory=dict)
    prefix: str = "sync__"


@dataclass(frozen=True)
class RunResult:
    """Outcome of a run: status, resolved mode, staged rows per stream, progress, error."""

    run_id: str
    status: str
    mode: Mode | None
    rows: Mapping[str, int] = field(default_factory=dict)
    progress: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    error: str | None = None
    drifted: bool = False

    @property
    def ok(self) -> bool:
        return self.status == runlog.SUCCESS


def adhoc_mode(type_: str = INCREMENTAL, period: str = DAILY, start=None, end=None, now: datetime | None = None) -> Mode:
    """The mode of a run outside its schedule: up to now, back by the lookback of the period."""
    if type_ != INCREMENTAL:
        return Mode.full()
    stop = as_utc(end or now or datetime.now(timezone.utc))
    return Mode.window(start or stop - Mode.delta(period), stop, period)


class _RunLog:
    """Writes the events of one run; a config without run log writes nothing."""

    def __init__(self, spark: SparkSession, cfg: SyncConfig, meta: Mapping[str, Any], now: datetime):
        self.spark, self.cfg, self.meta, self.created = spark, cfg, dict(meta), now
        self.run_id = uuid.uuid4().hex

    def add(self, status: str, output: Mapping[str, Any] | None = None) -> None:
        if self.cfg.run_log:
            moment = self.created if status == runlog.RUNNING else datetime.now(timezone.utc)
            runlog.append_run_event(
                self.spark, self.cfg.run_log, self.run_id, self.cfg.transfer_id, status,
                self.meta, output, self.created, max(moment, self.created),
            )


#: What a destination without schedule does.
UNSCHEDULED = {"frequency": DAILY, "type": "FULL_REFRESH"}


def resolve_mode(spark: SparkSession, cfg: SyncConfig, now: datetime) -> tuple[Mode, bool]:
    """Mode of a scheduled run, and whether rows before its window were never copied.

    The first run of a transfer is a full refresh. Without a run log the target decides: where a stream
    has none yet, nothing was ever copied.
    """
    mode = window_for(cfg.destination.get("schedule") or UNSCHEDULED, now)
    if not mode.incremental:
        return mode, False
    if not cfg.run_log:
        sink = make_sink(spark, cfg.destination, mode, False)
        missing = any(
            sink.missing(s, dataset)
            for dataset in read_models(spark, cfg, cfg.models, mode, SyncContext.at(now, prefix=cfg.prefix))
            for s in dataset.in_schema(sink.connect.get("target_schema"))
        )
        return (Mode.full(), False) if missing else (mode, False)
    reach = runlog.last_reach(runlog.read_run_log(spark, cfg.run_log, cfg.transfer_id), cfg.transfer_id)
    return (Mode.full(), False) if reach is None else (mode, runlog.starts_after(mode, reach))


def read_models(spark: SparkSession, cfg: SyncConfig, models: Sequence[ModelSpec], mode: Mode, ctx: SyncContext):
    """One lazy dataset per source, holding the streams of its models for the tenant."""
    marks = cfg.bookkeeping
    for source_id in dict.fromkeys(m.source_id for m in models):
        source = cfg.sources[source_id]
        config = {
            "mode": mode,
            "context": ctx,
            "with": {
                "batch_id": marks.batch_id, "checksum": marks.checksum,
                "version": marks.version, "last_sync": marks.last_sync,
            },
            "streams": [m.stream_for(cfg.tenant_id) for m in models if m.source_id == source_id],
            "connect": source["connection_info"],
            "types": cfg.types,
        }
        yield get_source(spark, get_source_by_vendor(source["vendor_type"]), config).read()


def make_sink(
    spark: SparkSession, destination: Mapping[str, Any], mode: Mode, trial: bool, parallel: int = 1
) -> Sink:
    config = {
        "mode": mode,
        "drop_after_complete": trial,
        "connect": destination["connection_info"],
        "batch_size": destination.get("batch_size"),
        "parallel": parallel,
    }
    return get_destination(spark, get_destination_by_vendor(destination["vendor_type"]), config)


def run_sync(
    spark: SparkSession,
    cfg: SyncConfig,
    mode: Mode | None = None,
    model_ids: Sequence[str] | None = None,
    drop_after_complete: bool = False,
    now: datetime | str | None = None,
    execution_id: str | None = None,
    retry_count: int = 0,
    on_progress: Listener | None = None,
) -> RunResult:
    """Run one transfer. Failures are recorded and returned, not raised.

    An explicit ``mode`` or ``model_ids`` overrides the schedule and skips the gap check.
    """
    now = as_utc(now) if now is not None else datetime.now(timezone.utc)
    ctx = SyncContext.at(now, prefix=cfg.prefix)
    progress: dict[str, dict[str, Any]] = {}
    rows: dict[str, int] = {}

    def note(p: Progress) -> None:
        progress[p.entity] = p.summary()
        if on_progress is not None:
            on_progress(p)

    override = mode is not None or model_ids is not None
    schedule = cfg.destination.get("schedule") or {}
    late = not override and schedule.get("frequency") is not None and drifted(schedule, now)
    stages: list[str] = []
    log = _RunLog(spark, cfg, {"execution_id": (execution_id or uuid.uuid4().hex).split(":")[-1]}, now)
    try:
        models = [m for m in cfg.models if model_ids is None or m.model_id in set(model_ids)]
        gap = False
        if not override:
            mode, gap = resolve_mode(spark, cfg, now)
        elif mode is None:
            mode = window_for(schedule or UNSCHEDULED, now)
        log.meta |= {
            "retry_count": retry_count,
            "drifted": late,
            "arguments": {
                "type": "transfer",
                "mode": mode.to_dict(),
                "models": [m.model_id for m in models],
                "drop_after_complete": drop_after_complete,
            },
        }
        log.add(runlog.RUNNING)
        if gap:
            raise RunGapDetected("the last successful run ended before the window of this run starts")
        sink = make_sink(spark, cfg.destination, mode, drop_after_complete, cfg.parallel)
        datasets = list(read_models(spark, cfg, models, mode, ctx))
        refuse_shared_targets([
            sink.target_key(s, d) for d in datasets for s in d.in_schema(sink.connect.get("target_schema"))
        ])
        for dataset in datasets:
            if sink.single_pass and not mode.incremental:
                # one sink that reads once: the rows go straight from source to target
                staged = dataset
            else:
                stages.append(fresh_folder(spark, f"stage-{ctx.batch_id}"))
                staged = stage_dataset(dataset, stages[-1], cfg.parallel, note)
            sink.write(staged, note)
            targets = staged.in_schema(sink.connect.get("target_schema"))
            for read, target in zip(staged, targets):
                known = read.rows if read.rows is not None else sink.written[sink.entity(staged, target)]
                rows[read.spec.qualified_name] = known
            if not drop_after_complete:
                sink.check(staged)
    except Exception as cause:
        error = f"{type(cause).__name__}: {cause}"
        log.add(runlog.FAILURE, {"cause": error, "progress": progress})
        return RunResult(log.run_id, runlog.FAILURE, mode, rows, progress, error, late)
    finally:
        for folder in stages:
            drop_stage(spark, folder)
    log.add(runlog.SUCCESS, {"success": True, "message": "complete", "progress": progress})
    if cfg.run_log:
        runlog.compact_run_log(spark, cfg.run_log, cfg.transfer_id)
    return RunResult(log.run_id, runlog.SUCCESS, mode, rows, progress, None, late)


def rerun(spark: SparkSession, cfg: SyncConfig, run_id: str, **options) -> RunResult:
    """Repeat a recorded run with the mode and models it had."""
    runs = runlog.current_runs(runlog.read_run_log(spark, cfg.run_log, cfg.transfer_id))
    path = "$.arguments"
    found = (
        runs.where(F.col("run_id") == run_id)
        .select(F.from_json(
            F.get_json_object("meta", path),
            "mode struct<type:string, period:string, start:string, end:string>, models array<string>, "
            "drop_after_complete boolean",
        ).alias("a"))
        .select("a.*")
        .first()
    )
    if found is None or found["mode"] is None:
        raise KeyError(f"no recorded run {run_id}")
    mode = Mode.from_config(found["mode"].asDict())
    return run_sync(
        spark, cfg, mode, list(found["models"]), drop_after_complete=bool(found["drop_after_complete"]), **options
    )


def self_test(spark: SparkSession, destination: Mapping[str, Any], tenant_id: str = "Customer1") -> RunResult:
    """Prove a destination works: load one day of fixture rows under a trial name, then drop them."""
    model = ModelSpec(
        "self-test", "fixture", FIXTURE_STREAM.schema_name, FIXTURE_STREAM.name,
        FIXTURE_STREAM.primary_field, "customer_id", FIXTURE_STREAM.cursor_field,
    )
    cfg = SyncConfig(
        "self-test", tenant_id, [model],
        {"fixture": {"vendor_type": "memory", "connection_info": {"namespace": "memory"}}}, destination,
    )
    return run_sync(spark, cfg, Mode.window("2025-01-01", "2025-01-02"), drop_after_complete=True)


def check_source(spark: SparkSession, source: Mapping[str, Any]) -> tuple[bool, str]:
    """Can the source be reached? Returns the verdict and a message."""
    try:
        connector = get_source(spark, get_source_by_vendor(source["vendor_type"]), {"connect": source["connection_info"]})
        connector.test_connect()
    except Exception as cause:
        return False, str(cause)
    return True, "connection successful"


def inspect_source(spark: SparkSession, source: Mapping[str, Any]) -> DataFrame:
    """The streams a source offers, as ``schema_name, stream_name, fields``."""
    connector = get_source(spark, get_source_by_vendor(source["vendor_type"]), {"connect": source["connection_info"]})
    return connector.inspect()
