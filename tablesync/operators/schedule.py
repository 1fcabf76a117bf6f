"""From a schedule and a moment to the window a run copies, on the driver and over a table."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.moments import minutes
from tablesync.operators.extract import column
from tablesync.spec import DRIFT, FULL_REFRESH, HOURLY, LOOKBACK, SIXHOURLY, WEEKLY, Mode, as_utc


def slot_end(frequency: str, now: datetime, hour: int | None = 0, minute: int | None = 0) -> datetime:
    """The end of the window: today's slot, this hour's slot, or the latest six-hourly slot reached."""
    now, hour, minute = as_utc(now), hour or 0, minute or 0
    if frequency == HOURLY:
        return now.replace(minute=minute, second=0, microsecond=0)
    if frequency == SIXHOURLY:
        slot = now.replace(hour=now.hour // 6 * 6, minute=minute, second=0, microsecond=0)
        return slot if slot <= now else slot - timedelta(hours=6)
    return now.replace(hour=hour, minute=minute, second=0, microsecond=0)


def window_for(schedule: Mapping[str, Any], now: datetime) -> Mode:
    """The replication mode of a scheduled run at ``now``."""
    frequency = schedule.get("frequency")
    if frequency not in LOOKBACK:
        raise ValueError(f"unknown schedule frequency: {frequency}")
    if schedule.get("type") == FULL_REFRESH:
        return Mode.full()
    end = slot_end(frequency, now, schedule.get("hour"), schedule.get("minute"))
    return Mode.window(end - LOOKBACK[frequency], end, frequency)


def drifted(schedule: Mapping[str, Any], now: datetime) -> bool:
    """Does a run start too far from its slot, or, if weekly, on another weekday (Monday is 0)?"""
    frequency = schedule["frequency"]
    now = as_utc(now)
    end = slot_end(frequency, now, schedule.get("hour"), schedule.get("minute"))
    wrong_day = frequency == WEEKLY and schedule.get("day") is not None and schedule["day"] != now.weekday()
    return wrong_day or abs(end - now) >= DRIFT[frequency]


def slot_end_column(frequency: str, now: Column, kind: T.DataType, hour: Any = 0, minute: Any = 0) -> Column:
    """Column form of :func:`slot_end`; ``hour`` and ``minute`` may be columns, NULL counts as 0."""
    def number(v: Any) -> Column:
        return F.coalesce(v if isinstance(v, Column) else F.lit(v), F.lit(0)).cast("int")

    hour, minute = number(hour), number(minute)
    # not date_trunc: it would read a naive timestamp as a wall clock of the session zone
    day = F.to_date(now).cast(kind)
    if frequency == HOURLY:
        return day + minutes(F.hour(now) * 60 + minute)
    if frequency == SIXHOURLY:
        slot = day + minutes(F.floor(F.hour(now) / 6).cast("int") * 360 + minute)
        return F.when(slot <= now, slot).otherwise(slot - F.lit(timedelta(hours=6)))
    return day + minutes(hour * 60 + minute)


def with_windows(
    df: DataFrame, now: str, frequency: str, hour: Any = 0, minute: Any = 0, prefix: str = "window_"
) -> DataFrame:
    """Append ``<prefix>start`` and ``<prefix>end`` of the run that starts at column ``now``."""
    if frequency not in LOOKBACK:
        raise ValueError(f"unknown schedule frequency: {frequency}")
    end = slot_end_column(frequency, column(now), df.schema[now].dataType, hour, minute)
    return df.withColumn(f"{prefix}end", end).withColumn(
        f"{prefix}start", F.col(f"{prefix}end") - F.lit(LOOKBACK[frequency])
    )


def with_drift(
    df: DataFrame, now: str, frequency: str, hour: Any = 0, minute: Any = 0, name: str = "drifted", day: Any = None
) -> DataFrame:
    """Append the drift verdict of runs that start at column ``now``."""
    at = column(now)
    end = slot_end_column(frequency, at, df.schema[now].dataType, hour, minute)
    limit = F.lit(DRIFT[frequency])
    late = (at - end >= limit) | (end - at >= limit)
    if frequency == WEEKLY and day is not None:
        late = late | (F.weekday(at) != (day if isinstance(day, Column) else F.lit(day)))
    return df.withColumn(name, late)
