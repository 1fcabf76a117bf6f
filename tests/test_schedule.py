"""Windows and drift: driver form, column form, decisions on edge cases."""

import datetime as dt

import pytest

from tablesync.operators.schedule import drifted, window_for, with_drift, with_windows
from tablesync.spec import DAILY, HOURLY, SIXHOURLY, WEEKLY, Mode

UTC = dt.timezone.utc


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


@pytest.mark.parametrize(
    ("schedule", "now", "start", "end"),
    [
        ({"frequency": DAILY, "hour": 6, "minute": 30}, "2025-01-10T06:31:12", "2025-01-09T03:30", "2025-01-10T06:30"),
        ({"frequency": WEEKLY, "hour": 6}, "2025-01-10T06:01", "2025-01-02T18:00", "2025-01-10T06:00"),
        ({"frequency": HOURLY, "hour": 3, "minute": 5}, "2025-01-10T09:07", "2025-01-10T07:50", "2025-01-10T09:05"),
        ({"frequency": SIXHOURLY, "hour": 0}, "2025-01-10T13:01", "2025-01-10T05:30", "2025-01-10T12:00"),
        ({"frequency": SIXHOURLY, "minute": 15}, "2025-01-10T12:01", "2025-01-09T23:45", "2025-01-10T06:15"),
        ({"frequency": DAILY, "hour": None, "minute": None}, "2025-01-10T00:02", "2025-01-08T21:00", "2025-01-10T00:00"),
    ],
)
def test_o2_windows(spark, schedule, now, start, end):
    mode = window_for(schedule, at(now))
    assert (mode.start, mode.end) == (at(start), at(end))
    df = spark.createDataFrame([(at(now).replace(tzinfo=None),)], "now timestamp_ntz")
    row = with_windows(df, "now", schedule["frequency"], schedule.get("hour"), schedule.get("minute")).first()
    assert (row.window_start, row.window_end) == (at(start).replace(tzinfo=None), at(end).replace(tzinfo=None))


def test_o2_full_refresh_and_bad_frequency(spark):
    assert window_for({"frequency": DAILY, "type": "FULL_REFRESH"}, at("2025-01-01T00:00")) == Mode.full()
    with pytest.raises(ValueError):
        window_for({"frequency": "YEARLY"}, at("2025-01-01T00:00"))
    with pytest.raises(ValueError):
        with_windows(spark.range(1), "id", "YEARLY")


def test_o2_slots_may_be_columns(spark):
    data = [(dt.datetime(2025, 1, 10, 7), 6, 30), (dt.datetime(2025, 1, 10, 7), None, None)]
    df = spark.createDataFrame(data, "now timestamp_ntz, h int, m int")
    got = [r.window_end for r in with_windows(df, "now", DAILY, df.h, df.m).collect()]
    assert got == [dt.datetime(2025, 1, 10, 6, 30), dt.datetime(2025, 1, 10)]


def test_q15_all_four_sixhourly_windows_cover_the_day():
    days = [window_for({"frequency": SIXHOURLY}, at(f"2025-01-10T{h:02d}:01")) for h in (0, 6, 12, 18)]
    assert len({m.end for m in days}) == 4
    assert all(b.start < a.end for a, b in zip(days, days[1:]))


@pytest.mark.parametrize(
    ("schedule", "now", "late"),
    [
        ({"frequency": DAILY, "hour": 6}, "2025-01-10T08:59:59", False),
        ({"frequency": DAILY, "hour": 6}, "2025-01-10T09:00", True),
        ({"frequency": DAILY, "hour": 6}, "2025-01-10T03:00", True),
        ({"frequency": HOURLY, "minute": 10}, "2025-01-10T03:24", False),
        ({"frequency": HOURLY, "minute": 10}, "2025-01-10T03:25", True),
        ({"frequency": SIXHOURLY}, "2025-01-10T12:59", False),
        ({"frequency": SIXHOURLY}, "2025-01-10T13:00", True),
        ({"frequency": WEEKLY, "hour": 6, "day": 4}, "2025-01-10T06:00", False),
        ({"frequency": WEEKLY, "hour": 6, "day": 0}, "2025-01-10T06:00", True),
    ],
)
def test_o3_drift(spark, schedule, now, late):
    assert drifted(schedule, at(now)) is late
    df = spark.createDataFrame([(at(now).replace(tzinfo=None),)], "now timestamp_ntz")
    out = with_drift(df, "now", schedule["frequency"], schedule.get("hour"), schedule.get("minute"), day=schedule.get("day"))
    assert out.first().drifted is late
