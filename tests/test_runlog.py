"""Run log queries: latest runs, listings, progress, rows transferred, gaps."""

import datetime as dt
import json
import random

import pytest

from conftest import plan_of, rows
from tablesync.operators import runlog
from tablesync.operators.integrity import batch_volumes, check_referential, foreign_rows, orphans
from tablesync.progress import Progress, percent, remaining_seconds, rows_per_second
from tablesync.spec import Mode
from tablesync.workspace import fresh_folder

UTC = dt.timezone.utc


def at(hour, minute=0, day=1):
    return dt.datetime(2025, 1, day, hour, minute, tzinfo=UTC)


def run(run_id, transfer="t", status="SUCCESS", execution="e", created=at(0), modified=None, output=None, arguments=None):
    meta = {"execution_id": execution, **({"arguments": arguments} if arguments else {})}
    return (run_id, transfer, status, json.dumps(meta), output and json.dumps(output), created, modified or created)


def log(spark, *runs):
    return spark.createDataFrame(list(runs), runlog.RUN_EVENT)


def progress(**entries):
    return {"progress": {name: {"entity": name.replace("__", "://"), "processed": n} for name, n in entries.items()}}


# ---- O7


def test_o7_events_become_run_states(spark):
    path = fresh_folder(spark, "runs")
    assert runlog.read_run_log(spark, path).count() == 0
    for status, moment in (("RUNNING", at(1)), ("SUCCESS", at(1))):
        runlog.append_run_event(spark, path, "r1", "t1", status, {"execution_id": "e"}, None, at(1), moment)
    runlog.append_run_event(spark, path, "r2", "t2", "RUNNING", {}, None, at(2), at(2))
    states = runlog.current_runs(runlog.read_run_log(spark, path))
    assert rows(states.select("run_id", "status")) == [("r1", "SUCCESS"), ("r2", "RUNNING")]
    assert [r.run_id for r in runlog.read_run_log(spark, path, "t2").collect()] == ["r2"]


# ---- W2, W3, L1, L2, J5, J6


def test_w2_retries_collapse_to_the_newest(spark):
    runs = log(
        spark,
        run("a", execution="e1", created=at(1), modified=at(5)),
        run("b", execution="e1", created=at(2), modified=at(6)),
        run("c", execution="e2", created=at(3), modified=at(7)),
        run("d", execution="e2", created=at(4), modified=at(7)),
    )
    # on a tie the first of a newest-first listing stays
    assert rows(runlog.latest_per_execution(runs).select("execution_id", "run_id")) == [("e1", "b"), ("e2", "d")]


def test_w3_latest_run_by_status(spark):
    runs = log(spark, run("a", created=at(1)), run("b", created=at(2), status="FAILURE"), run("c", "u", created=at(1)))
    assert rows(runlog.latest_run(runs).select("transfer_id", "run_id")) == [("t", "b"), ("u", "c")]
    assert rows(runlog.latest_run(runs, "SUCCESS").select("run_id")) == [("a",), ("c",)]
    assert runlog.latest_run_of(runs, "t").first().run_id == "b"
    assert runlog.latest_run_of(runs, "t", "SUCCESS").first().run_id == "a"
    assert runlog.latest_run_of(runs, "x").isEmpty()


def test_l1_top_run_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(runlog.latest_run_of(log(spark, run("a")), "t"))


def test_l2_j5_pages_tile_the_listing(spark):
    runs = log(spark, *[run(f"r{i:02d}", f"t{i % 3}", created=at(i // 5), execution=f"e{i % 2}") for i in range(30)])
    transfers = spark.createDataFrame([("t0", "d1"), ("t1", "d1"), ("t2", "d2")], "transfer_id string, destination_id string")
    whole = [r.run_id for r in runlog.list_runs(runs, transfers, "d1").collect()]
    assert len(whole) == 20 and whole[0] == "r25"
    paged = [r.run_id for o in range(0, 20, 7) for r in runlog.list_runs(runs, transfers, "d1", offset=o, limit=7).collect()]
    assert paged == whole
    assert runlog.list_runs(runs, transfers, "d1", execution="e1").count() == 10
    with pytest.raises(ValueError):
        runlog.list_runs(runs, transfers, "d1", limit=0)


def test_j6_listing_of_an_organisation(spark):
    recipients = spark.createDataFrame([("r1", "o1"), ("r2", "o2")], "recipient_id string, organization_id string")
    destinations = spark.createDataFrame([("d1", "r1"), ("d2", "r2"), ("d3", "r1")], "destination_id string, recipient_id string")
    got = runlog.list_for_org(destinations, recipients, "recipient_id", "o1")
    assert rows(got.select("destination_id")) == [("d1",), ("d3",)]


def test_a5_distinct_sources(spark):
    models = spark.createDataFrame([("m1", "s1"), ("m2", "s1"), ("m3", "s2")], "model_id string, source_id string")
    assert rows(runlog.distinct_sources(models)) == [("s1",), ("s2",)]


# ---- A3, A4


@pytest.mark.parametrize(
    ("output", "want", "compat"),
    [
        (None, None, None),
        ({"other": 1}, None, None),
        ({"progress": {}}, None, None),
        (progress(source_1=1000, destination_1=1000), 1000, 1000),
        (progress(source_1=100, destination_1=0), 0, 0),
        (progress(source_1=100), 0, 0),
        ({"progress": {"destination": {"entity": "destination", "processed": 10.9}}}, 10, 10),
        ({"progress": {"a": {"entity": "destination+s3://n/s/t", "processed": 5}, "b": {"entity": "destination+db://n/s/t", "processed": 5},
                       "c": {"entity": "destination+s3://n/s/u", "processed": 2}}}, 7, 12),
        ({"progress": {"a": {"entity": "destination", "total": 5}}}, 0, 0),
        ({"progress": {"a": 7, "b": {"entity": "destination", "processed": 3}, "c": {"entity": 9, "processed": 4}}}, 3, 3),
    ],
)
def test_a3_q9_rows_transferred(spark, output, want, compat):
    runs = log(spark, run("r", output=output))
    assert runlog.rows_transferred(runs).first() == ("r", want)
    assert runlog.rows_transferred(runs, compat=True).first() == ("r", compat)


def test_a3_needs_no_shuffle(spark):
    assert "Exchange" not in plan_of(runlog.rows_transferred(log(spark, run("r"))))


def test_a4_progress_on_the_driver():
    p = Progress("source", total=200, at=0.0)
    assert percent(p) == 0.0 and remaining_seconds(p) is None and rows_per_second(p) == 0.0
    p = p.later(50, at=2.0)
    assert (percent(p), rows_per_second(p), remaining_seconds(p)) == (25.0, 25.0, 6.0)
    p = p.later(100, "half", at=4.0)
    assert p.summary() == {
        "entity": "source", "processed": 100, "total": 200, "percent": 50.0, "rate_rps": 25.0, "eta_seconds": 4.0, "message": "half",
    }
    assert percent(Progress("x").later(5)) == 0.0 and rows_per_second(p.later(120, at=4.0)) == 0.0


def test_a4_progress_over_updates(spark):
    data = [("r", "a", 10, 100, at(0, 0)), ("r", "a", 30, 100, at(0, 10)), ("r", "a", 60, 100, at(0, 20)), ("r", "b", 5, 0, at(0))]
    df = spark.createDataFrame(data, "run_id string, entity string, processed bigint, total bigint, at timestamp")
    got = {r.entity: r for r in runlog.progress_summary(df).collect()}
    assert (got["a"].processed, got["a"].percent, got["a"].rate_rps, got["a"].eta_seconds) == (60, 60.0, 0.05, 800.0)
    assert (got["b"].percent, got["b"].rate_rps, got["b"].eta_seconds) == (0.0, 0.0, None)


def test_a4_entries_of_the_output(spark):
    output = {"progress": {"x": {"entity": "x", "processed": 1, "total": 3, "message": "m"}}}
    row = runlog.progress_entries(log(spark, run("r", output=output))).first()
    assert (row.entity, row.processed, row.total, row.percent, row.message) == ("x", 1, 3, 33.33, "m")


# ---- W4


def brute_gaps(data, lookback):
    out = []
    for who in {w for w, _ in data}:
        times = sorted(t for w, t in data if w == who)
        out += [(who, b, a) for a, b in zip(times, times[1:]) if a < b - lookback]
    return sorted(out, key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("seed", range(3))
def test_w4_run_gaps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = dt.datetime(2025, 1, 1)
    lookback = dt.timedelta(hours=27)
    steps = [dt.timedelta(0), dt.timedelta(hours=1), lookback, lookback + dt.timedelta(microseconds=1), dt.timedelta(days=5)]
    data = []
    for who in ("hot", "a", "b"):
        moment = base
        for _ in range(120 if who == "hot" else 20):
            moment += rng.choice(steps)
            data.append((who, moment))
    df = spark.createDataFrame(data, "transfer_id string, created_at timestamp_ntz")
    assert rows(runlog.run_gaps(df, lookback)) == brute_gaps(data, lookback)


@pytest.mark.parametrize("seed", range(2))
def test_w4_window_gaps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = dt.datetime(2025, 1, 1)
    data = [
        (who, start, start + dt.timedelta(hours=rng.randrange(12)))
        for who in "ab"
        for start in (base + dt.timedelta(hours=rng.randrange(24 * 20)) for _ in range(60))
    ]
    want = []
    for who in "ab":
        covered, seen = None, set()
        for w, start, end in sorted(d for d in data if d[0] == who):
            if covered is not None and covered < start and start not in seen:
                want.append((who, start, end, covered))
            seen.add(start)
            covered = end if covered is None else max(covered, end)
    df = spark.createDataFrame(data, "transfer_id string, window_start timestamp_ntz, window_end timestamp_ntz")
    assert rows(runlog.window_gaps(df)) == sorted(want, key=lambda t: tuple(map(str, t)))


def test_w4_q10_gap_of_a_scheduled_run(spark):
    window = {"mode": {"type": "INCREMENTAL", "start": "2024-12-31T03:00:00+00:00", "end": "2025-01-01T06:00:00+00:00"}}
    runs = log(spark, run("a", created=at(7), arguments=window), run("b", created=at(9, day=2), status="FAILURE"))
    assert not runlog.has_run_gap(runs, "t", Mode.window(at(3), at(6, day=2)))
    assert runlog.has_run_gap(runs, "t", Mode.window(at(6, 30), at(9, day=2)))
    assert not runlog.has_run_gap(runs, "t", Mode.full())
    assert not runlog.has_run_gap(runs, "other", Mode.window(at(6, 30), at(9, day=2)))
    unrecorded = log(spark, run("a", created=at(7)))
    assert not runlog.has_run_gap(unrecorded, "t", Mode.window(at(6, 30), at(9, day=2)))


# ---- A2, A6, tenant leak


def test_a2_batch_volumes(spark):
    ddl = "sync__batch_id string"
    staged = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], ddl)
    target = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("d",)], ddl)
    want = [("a", 2, 2, True), ("b", 2, 1, False), ("c", 0, 1, False), ("d", 1, 0, False)]
    assert rows(batch_volumes(target, staged)) == want


def test_a6_orphans(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (9,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(orphans(child, parent, {"fk": "id"})) == [(9, 2), (None, 1)]
    assert check_referential(child, parent, {"fk": "id"}).first().orphans == 3
    assert check_referential(parent.withColumnRenamed("id", "fk"), parent, {"fk": "id"}).first().orphans == 0


def test_foreign_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "tenant string")
    assert rows(foreign_rows(df, "tenant", ["a"])) == [("b",), (None,)]


def test_o7_event_files_are_gathered_by_month(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(6):
        day = dt.datetime(2025, 1 + i // 3, 1 + i, tzinfo=dt.timezone.utc)
        runlog.append_run_event(spark, path, f"r{i}", "t1", runlog.SUCCESS, {"k": i}, None, day, day)
    runlog.append_run_event(spark, path, "other", "t2", runlog.SUCCESS, {}, None, day, day)
    before = rows(runlog.read_run_log(spark, path))
    assert runlog.compact_run_log(spark, path, "t1", above=6) == 6, "few enough"
    assert runlog.compact_run_log(spark, path, "t1", above=5) <= 2
    assert rows(runlog.read_run_log(spark, path)) == before
    assert rows(runlog.read_run_log(spark, path, "t1").select("run_id")) == [(f"r{i}",) for i in range(6)]
