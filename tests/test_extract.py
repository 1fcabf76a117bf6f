"""Predicates, projection, counts and bookkeeping columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from tablesync.errors import SourceStreamInvalidSchema, StreamError, StreamMissingField
from tablesync.operators.augment import augment
from tablesync.operators.extract import extract, stream_count, validate
from tablesync.spec import Bookkeeping, Mode, StreamSpec, SyncContext

DDL = "id bigint, at timestamp, tenant string, n int"


@pytest.fixture(scope="module")
def stream(spark):
    day = lambda d: dt.datetime(2025, 1, d, tzinfo=dt.timezone.utc)
    data = [(1, day(1), "a", 1), (2, day(2), "a", 2), (3, day(3), "b", 3), (4, None, "a", 4), (5, day(2), None, 5)]
    return spark.createDataFrame(data, DDL)


SPEC = StreamSpec("t", "s", "id", "at")


def ids(df):
    return [r[0] for r in rows(df.select("id"))]


def test_p2_window_is_half_open_and_skips_null_cursors(stream):
    assert ids(extract(stream, SPEC, Mode.window("2025-01-01", "2025-01-02"))) == [1]
    assert ids(extract(stream, SPEC, Mode.window("2025-01-02", "2025-01-04"))) == [2, 3, 5]


def test_p2_adjacent_windows_tile_the_range(stream):
    days = [f"2025-01-{d:02d}" for d in range(1, 6)]
    parts = [ids(extract(stream, SPEC, Mode.window(a, b))) for a, b in zip(days, days[1:])]
    assert sorted(sum(parts, [])) == ids(extract(stream, SPEC, Mode.window(days[0], days[-1]))) == [1, 2, 3, 5]


def test_p3_p5_filters_apply_in_both_modes(stream):
    spec = StreamSpec("t", "s", "id", "at", {"tenant": "a"})
    assert ids(extract(stream, spec)) == [1, 2, 4]
    assert ids(extract(stream, spec, Mode.window("2025-01-01", "2025-01-03"))) == [1, 2]


def test_p3_filters_are_anded_and_cast_to_the_column(stream):
    assert ids(extract(stream, StreamSpec("t", "s", "id", filters={"tenant": "a", "n": "2"}))) == [2]


def test_q16_boolean_filters(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    assert ids(extract(df, StreamSpec("t", "", "id", filters={"ok": True}))) == [1]
    assert ids(extract(df, StreamSpec("t", "", "id", filters={"ok": False}))) == [2]


def test_p4_none_matches_nothing(stream):
    assert ids(extract(stream, StreamSpec("t", "s", "id", filters={"tenant": None}))) == []


def test_date_and_string_cursors(spark):
    df = spark.sql("select 1 id, date'2025-01-02' d, '2025-01-02T00:00:00+00:00' s union all select 2, date'2025-01-03', 'x'")
    window = Mode.window("2025-01-02", "2025-01-03")
    assert ids(extract(df, StreamSpec("t", "", "id", "d"), window)) == [1]
    assert ids(extract(df, StreamSpec("t", "", "id", "s"), window)) == [1]
    assert ids(extract(df, StreamSpec("t", "", "id", "d"), Mode.window("2025-01-02T12:00", "2025-01-03T12:00"))) == [2]


def test_p19_include_columns_keeps_key_cursor_and_filters(stream):
    spec = StreamSpec("t", "s", "id", "at", {"tenant": "a"}, include_columns=("n",))
    assert extract(stream, spec).columns == ["id", "at", "tenant", "n"]
    assert extract(stream, StreamSpec("t", "s", "id", include_columns=("n",))).columns == ["id", "n"]


@pytest.mark.parametrize(
    "spec",
    [StreamSpec("t", "s", "nope"), StreamSpec("t", "s", "id", "nope"), StreamSpec("t", "s", "id", filters={"nope": 1})],
)
def test_s11_missing_columns(stream, spec):
    with pytest.raises(SourceStreamInvalidSchema):
        extract(stream, spec)


def test_q21_incremental_needs_a_cursor(stream):
    with pytest.raises(StreamError):
        validate(stream.schema, StreamSpec("t", "s", "id"), Mode.window("2025-01-01", "2025-01-02"))


def test_s12_count_uses_the_predicates_of_the_scan(stream):
    window = Mode.window("2025-01-02", "2025-01-04")
    assert stream_count(stream, SPEC, window).first()[0] == extract(stream, SPEC, window).count() == 3


def test_predicates_and_projection_reach_the_scan(events):
    spec = StreamSpec("events", "", "event_id", "ts", {"event_type": "click"}, include_columns=("value",))
    plan = plan_of(extract(events, spec, Mode.window("2024-01-10", "2024-01-17")))
    assert "GreaterThanOrEqual(ts,2024-01-10T00:00)" in plan and "LessThan(ts,2024-01-17T00:00)" in plan
    assert "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan


# ---- bookkeeping


CTX = SyncContext.at("2025-01-10T00:00:00Z", prefix="x__")


def test_p13_order_of_bookkeeping_columns(stream):
    marks = Bookkeeping(batch_id=True, checksum=True, version="1.0", last_sync=True)
    out = augment(stream, CTX, marks, drop=["tenant"], extra={"k": ("int", 7)})
    names = ["id", "at", "n", "k", "x__batch_id", "x__checksum", "x__version", "x__last_synced_at"]
    assert out.columns == names
    kinds = dict(out.dtypes)
    assert kinds["x__batch_id"] == kinds["x__version"] == "string"
    assert kinds["x__last_synced_at"] == "timestamp" and kinds["k"] == "int"


def test_p10_sync_time_is_one_literal(stream):
    out = augment(stream, CTX, Bookkeeping(last_sync=True))
    assert out.select(F.unix_millis("x__last_synced_at")).distinct().collect()[0][0] == 1736467200000


def test_p12_checksum_sees_dropped_columns(stream):
    marks = Bookkeeping(checksum=True)
    whole = rows(augment(stream, CTX, marks).select("x__checksum"))
    assert whole == rows(augment(stream, CTX, marks, drop=["tenant", "n"]).select("x__checksum"))


def test_p6_drops_by_name_in_any_order(stream):
    assert augment(stream, CTX, drop=["tenant", "id"]).columns == ["at", "n"]
    assert augment(stream, CTX, drop=["id", "tenant"]).columns == ["at", "n"]
    with pytest.raises(StreamMissingField):
        augment(stream, CTX, drop=["nope"])


def test_p8_e1_computed_columns_see_the_raw_row(stream):
    out = augment(stream, CTX, drop=["n"], extra={"twice": lambda raw: F.col("n") * 2})
    assert rows(out.select("id", "twice"))[:2] == [(1, 2), (2, 4)]


def test_e1_a_pandas_udf_may_compute_a_column(stream):
    import pandas as pd

    @F.pandas_udf("bigint")
    def plus_one(v: pd.Series) -> pd.Series:
        return v + 1

    out = augment(stream, CTX, extra={"next": lambda raw: plus_one(F.col("id"))})
    assert rows(out.select("next")) == [(i,) for i in range(2, 7)]


def test_p3_values_a_type_cannot_hold_match_nothing_and_are_still_pushed(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "typed")
    spark.range(10).select(F.col("id").cast("int").alias("k"), (F.col("id") / 2).alias("x")).write.parquet(path)
    rows = spark.read.parquet(path)
    want = [(1, 1), (1.0, 1), (1.5, 0), (2**40, 0), (2**80, 0), ("1", 1), ("abc", 0), (True, 0)]
    for value, n in want:
        assert extract(rows, StreamSpec("t", filters={"k": value})).count() == n, value
    assert extract(rows, StreamSpec("t", filters={"x": 0.5})).count() == 1
    assert "EqualTo(k,1)" in plan_of(extract(rows, StreamSpec("t", filters={"k": "1"})))
