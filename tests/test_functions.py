"""Types, checksums, identifiers, time helpers, join sizing."""

import datetime as dt
import decimal
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import plan_of, rows
from tablesync.functions import moments
from tablesync.functions.checksum import row_checksum
from tablesync.functions.identifiers import safe_identifier, safe_identifier_column, with_safe_columns
from tablesync.functions.sizing import broadcast_if_small, is_small
from tablesync.functions.types import build_schema, infer_schema, normalise, schemas_compatible, type_family

UTC = dt.timezone.utc


# ---- P15, P16, K15


def test_p15_build_schema():
    schema = build_schema([("id", int), ("name", str), ("at", dt.datetime), ("day", dt.date), ("raw", dict), ("u", uuid.UUID)])
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "string", "timestamp", "date", "string", "string"]


def test_p15_string_fallbacks():
    schema = build_schema([("a", "DATE"), ("b", "TIMESTAMP_NTZ"), ("c", "TIMESTAMP_TZ"), ("d", decimal.Decimal), ("e", bytes)])
    assert [f.dataType.simpleString() for f in schema] == ["date", "timestamp", "timestamp", "double", "binary"]


def test_p15_unknown_type_is_refused():
    with pytest.raises(ValueError):
        build_schema([("xs", list)])


def test_p16_infer_schema(spark):
    schema = infer_schema(spark, ["id", "name", "score", "ok"], [1, "Mike", 1.5, True])
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "string", "double", "boolean"]


def test_type_families():
    assert type_family(T.ShortType()) == type_family(T.LongType()) == type_family(T.DecimalType(10, 0)) == "int64"
    assert type_family(T.FloatType()) == type_family(T.DecimalType(10, 2), "double") == "float64"
    assert type_family(T.VarcharType(3)) == type_family(T.StringType()) == "string"
    assert type_family(T.TimestampNTZType()) == type_family(T.TimestampType())


def _schema(text):
    return T.StructType.fromDDL(text)


BASE = "id bigint, name string, is_active boolean, created_at timestamp"


@pytest.mark.parametrize(
    ("other", "fits"),
    [
        (BASE, True),
        ("created_at timestamp, is_active boolean, name string, id bigint", True),
        ("id int, name varchar(20), is_active boolean, created_at timestamp", True),
        ("id bigint, name string, is_active boolean", False),
        (BASE + ", extra string", False),
        ("id string, name string, is_active boolean, created_at timestamp", False),
        ("id bigint, name string, is_active boolean, created_at date", False),
    ],
)
def test_k15_schema_compatibility(other, fits):
    assert schemas_compatible(_schema(BASE), _schema(other)) is fits
    assert schemas_compatible(_schema(other), _schema(BASE)) is fits


def test_k15_numeric_columns():
    assert schemas_compatible(_schema("n double"), _schema("n decimal(12,2)"))
    assert schemas_compatible(_schema("n bigint"), _schema("n decimal(38,0)"))
    assert not schemas_compatible(_schema("n bigint"), _schema("n decimal(38,2)"))


# ---- P14


def test_p14_normalise(spark):
    df = spark.sql(
        "select 1Y a, 2S b, 3 c, cast(1.5 as float) d, cast(2.25 as decimal(10,2)) e, cast('x' as varchar(5)) f, "
        "timestamp_ntz'2025-01-01 10:00:00.123456' g, named_struct('k', 1) h, null i, map('x', 1) j"
    )
    kept = normalise(df)
    assert [f.dataType.simpleString() for f in kept.schema] == [
        "bigint", "bigint", "bigint", "double", "decimal(10,2)", "string", "timestamp_ntz", "struct<k:int>", "string", "map<string,int>",
    ]
    flat = normalise(df, decimals="double", ntz="instant", naive_tz="+02:00", nested="json")
    row = flat.first()
    assert (row.e, row.h, row.j, row.i) == (2.25, '{"k":1}', '{"x":1}', None)
    assert flat.select(F.unix_micros("g")).first()[0] == int(dt.datetime(2025, 1, 1, 8, tzinfo=UTC).timestamp()) * 10**6 + 123456


def test_p14_times_and_variants_become_text(spark):
    df = normalise(spark.sql("""select time'10:11:12.5' t, parse_json('{"a": 1}') v"""))
    assert df.dtypes == [("t", "string"), ("v", "string")] and df.first() == ("10:11:12.5", '{"a":1}')


# ---- P12, F1, F2


def test_p12_checksum_golden(spark):
    df = spark.createDataFrame([(0, "Mike", 35)], "id bigint, name string, age int")
    assert df.select(row_checksum(df)).first()[0] == "a69499fa594eb140007eea50e0fdee73"


def test_p12_checksum_prints_values_like_python(spark):
    floats = [0.0, -0.0, 1.0, 0.1, 1e-3, 1.25e-4, 9.5e-5, 1e-5, 1e-10, 1234567.0, 1e7, 12345678.9, 1.5e15, 9.007199254740991e15,
              1e16, 1.5e16, 1e22, -2.5e-7, -1e7, 1e100, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), None]
    stamps = [dt.datetime(2025, 1, 1, 10, 0, 0, 120000), dt.datetime(2025, 1, 1), None]
    data = [(x, stamps[i % 3], i % 2 == 0, dt.date(2024, 2, i % 28 + 1), decimal.Decimal("12.30")) for i, x in enumerate(floats)]
    df = spark.createDataFrame(data, "x double, at timestamp_ntz, ok boolean, day date, amount decimal(10,2)")
    got = [r[0] for r in df.select(row_checksum(df)).collect()]
    want = [hashlib.md5("".join(map(str, row)).encode()).hexdigest() for row in data]
    assert got == want


def test_p12_instants_carry_their_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 10, tzinfo=UTC),)], "at timestamp")
    assert df.select(row_checksum(df)).first()[0] == hashlib.md5(b"2025-01-01 10:00:00+00:00").hexdigest()


def test_q4_v2_checksum_separates_columns(spark):
    df = spark.createDataFrame([("1", "23"), ("12", "3")], "a string, b string")
    assert df.select(row_checksum(df)).distinct().count() == 1
    assert df.select(row_checksum(df, "v2")).distinct().count() == 2


def test_checksum_refuses_binary(spark):
    df = spark.createDataFrame([(bytearray(b"x"),)], "b binary")
    with pytest.raises(ValueError):
        row_checksum(df)


# ---- P17, F7


CASES = ["abc", "1a-b c", "my.table", "99x.88y", "a" * 80, "ünder-größe", "a--b", "_x", "tab\tle", "x.1-2y"]


@pytest.mark.parametrize("name", ["123", "", "é", "a..b", "ok.7"])
def test_p17_unusable_identifiers(name):
    with pytest.raises(ValueError):
        safe_identifier(name)


def test_p17_examples():
    assert safe_identifier("1a-b c") == "a_b_c"
    assert safe_identifier("public.my table") == "public.my_table"
    assert safe_identifier("123", "fallback") == "fallback"
    assert len(safe_identifier("a" * 80)) == 64


def test_p17_column_form_agrees_with_driver_form(spark):
    names = CASES + ["123", "", "é", "a..b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = dict(df.select("n", safe_identifier_column(F.col("n"))).collect())
    for name in names:
        try:
            want = safe_identifier(name)
        except ValueError:
            want = None
        assert got[name] == want, name
    filled = dict(df.select("n", safe_identifier_column(F.col("n"), "d")).collect())
    assert filled["123"] == "d" and filled["a..b"] == "a.d.b"


def test_p17_schema_form(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `1x` int")
    assert with_safe_columns(df).columns == ["a_b", "x"]


# ---- F3-F6, F9-F11


def test_typed_literals_follow_the_column(spark):
    moment = dt.datetime(2025, 1, 1, 12, 30, tzinfo=UTC)
    df = spark.range(1).select(
        moments.typed_literal(moment, T.TimestampNTZType()).alias("a"),
        moments.typed_literal(moment, T.TimestampType()).alias("b"),
        moments.typed_literal("7", T.LongType()).alias("c"),
        moments.typed_literal(None, T.StringType()).alias("d"),
        moments.typed_literal(dt.datetime(2025, 1, 1), T.DateType()).alias("e"),
        moments.typed_literal(moment, T.StringType()).alias("f"),
    )
    row = df.first()
    assert (row.a, row.c, row.d, row.e) == (dt.datetime(2025, 1, 1, 12, 30), 7, None, dt.date(2025, 1, 1))
    assert row.f == "2025-01-01T12:30:00+00:00"
    with pytest.raises(ValueError):
        moments.typed_literal([1], T.LongType())
    with pytest.raises(ValueError):
        moments.typed_literal(moment, T.LongType())


def test_wall_micros_ignores_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 7, 1, 3, 4, 5, 678901),)], "at timestamp_ntz")
    want = int((dt.datetime(2025, 7, 1, 3, 4, 5, 678901) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(moments.wall_micros(F.col("at"), T.TimestampNTZType())).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_f9_malformed_iso_text_is_null(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00+02:00",), ("nope",)], "s string")
    got = [r[0] for r in df.select(F.unix_seconds(moments.parse_iso(F.col("s")))).collect()]
    assert got == [int(dt.datetime(2024, 12, 31, 22, tzinfo=UTC).timestamp()), None]


def test_f10_to_utc(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 7, 1, 12),)], "at timestamp_ntz")
    assert df.select(moments.to_utc(F.col("at"), "Europe/Berlin")).first()[0] == dt.datetime(2025, 7, 1, 10)


# ---- sizing


def test_broadcast_only_within_counted_bounds(spark):
    small, wide = spark.range(10), spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert is_small(small, 10) and not is_small(small, 9)
    assert not is_small(wide, 100, max_bytes=5000)
    big = spark.range(1000).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(big.join(broadcast_if_small(small), big.k == small.id))
        assert "BroadcastHashJoin" not in plan_of(big.join(broadcast_if_small(small, 5), big.k == small.id))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(broadcast_if_small(small, 5)) == [(i,) for i in range(10)]
