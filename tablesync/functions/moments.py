"""Date and time expressions: literals typed by column, formats, epochs, schedule slots."""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.spec import as_utc

# Date formats used in target paths.
DAY_PATH = "yyyy-MM-dd"
DAY_NAME = "yyyy_MM_dd"
SECOND_NAME = "yyyyMMddHHmmss"


def typed_literal(value: Any, data_type: T.DataType) -> Column:
    """A literal of the column's own type, so the comparison is pushed to the scan."""
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(value, dt.datetime):
        moment = as_utc(value)
        if isinstance(data_type, T.TimestampNTZType):
            return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast(data_type)
        if isinstance(data_type, T.TimestampType):
            return F.lit(moment.isoformat(sep=" ")).cast(data_type)
        if isinstance(data_type, T.DateType):
            naive = moment.replace(tzinfo=None)
            if naive.time() == dt.time():
                return F.lit(naive.date())
            return F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz")
        if isinstance(data_type, T.StringType):
            return F.lit(moment.isoformat())
        raise ValueError(f"cannot compare a {data_type.simpleString()} column with a point in time")
    if isinstance(value, dt.date):
        return F.lit(value).try_cast(data_type) if not isinstance(data_type, T.StringType) else F.lit(value.isoformat())
    if isinstance(value, (bool, int, float, str, decimal.Decimal)):
        return _exact_literal(value, data_type)
    raise ValueError(f"unsupported filter value type: {type(value).__name__}")


def _exact_literal(value: bool | int | float | str | decimal.Decimal, data_type: T.DataType) -> Column:
    """The value in the column's type, or a typed NULL, which matches nothing, if that type cannot hold it exactly."""
    nothing = F.lit(None).cast(data_type)
    if isinstance(data_type, T.StringType):
        return F.lit(value).cast(data_type)
    if isinstance(value, bool) or isinstance(data_type, T.BooleanType):
        same = isinstance(value, (bool, str)) and isinstance(data_type, T.BooleanType)
        return F.lit(value).try_cast(data_type) if same else nothing
    if isinstance(value, str):
        return F.lit(value).try_cast(data_type)
    if isinstance(data_type, T.IntegralType):
        # Python numbers compare by value, so 2.0 is 2 and 1.5 or a number out of range is nothing
        if value != value or value in (float("inf"), float("-inf")) or value != int(value) or not -(2**63) <= value < 2**63:
            return nothing
        return F.lit(int(value)).try_cast(data_type)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        exact = isinstance(value, float) or abs(value) <= 2**1023 and float(value) == value
        return F.lit(float(value)).cast(data_type) if exact else nothing
    if isinstance(data_type, T.DecimalType):
        wide = isinstance(value, int) and not -(2**63) <= value < 2**63
        return F.lit(decimal.Decimal(value)) if wide and len(str(abs(value))) <= 38 else nothing if wide else F.lit(value)
    return nothing


def instant_literal(moment: dt.datetime, type_name: str = "timestamp") -> Column:
    """One fixed point in time as a ``timestamp`` or ``timestamp_ntz`` literal."""
    kind = T.TimestampNTZType() if type_name == "timestamp_ntz" else T.TimestampType()
    return typed_literal(moment, kind)


def epoch_millis_text(ts: Column, data_type: T.DataType = T.TimestampType()) -> Column:
    """Milliseconds since the epoch, as the text used for batch ids."""
    micros = wall_micros(ts, data_type)
    return ((micros - F.pmod(micros, F.lit(1000))) / F.lit(1000)).cast("bigint").cast("string")


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to an instant; malformed text becomes NULL."""
    return F.try_to_timestamp(text)


def to_utc(ts: Column, source_zone: str) -> Column:
    """Wall clock of ``source_zone`` to a naive UTC wall clock."""
    return F.convert_timezone(F.lit(source_zone), F.lit("UTC"), ts)


def minutes(n: Any) -> Column:
    """An interval of ``n`` minutes."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.make_dt_interval(F.lit(0), F.lit(0), n)


def wall_micros(ts: Column, data_type: T.DataType) -> Column:
    """Microseconds since 1970 of an instant, or of a naive wall clock whatever the session zone."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(ts)
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    if isinstance(data_type, T.DateType):
        return days * F.lit(86_400_000_000)
    within = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint") * F.lit(60_000_000)
    seconds = (F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint")
    return days * F.lit(86_400_000_000) + within + seconds
