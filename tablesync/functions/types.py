"""Declared types, type families and value normalisation (all as Catalyst casts)."""

from __future__ import annotations

import datetime as dt
import decimal
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared Python type or SQL name -> column type of the stream.
DECLARED_TYPES: dict[Any, T.DataType] = {
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bool: T.BooleanType(),
    bytes: T.BinaryType(),
    dt.date: T.DateType(),
    dt.datetime: T.TimestampType(),
    dt.time: T.StringType(),
    type(None): T.NullType(),
    uuid.UUID: T.StringType(),
    decimal.Decimal: T.DoubleType(),
    dict: T.StringType(),
    "DATE": T.DateType(),
    "TIME": T.StringType(),
    "TIMESTAMP_NTZ": T.TimestampType(),
    "TIMESTAMP_LTZ": T.TimestampType(),
    "TIMESTAMP_TZ": T.TimestampType(),
}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_STRINGS = (T.StringType, T.CharType, T.VarcharType)
_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def contains(data_type: T.DataType, *kinds: type[T.DataType]) -> bool:
    """Does a type have one of ``kinds`` at any depth?"""
    if isinstance(data_type, kinds):
        return True
    if isinstance(data_type, T.ArrayType):
        return contains(data_type.elementType, *kinds)
    if isinstance(data_type, T.MapType):
        return contains(data_type.keyType, *kinds) or contains(data_type.valueType, *kinds)
    if isinstance(data_type, T.StructType):
        return any(contains(f.dataType, *kinds) for f in data_type.fields)
    return False


def comparable(data_type: T.DataType) -> bool:
    """Can values of the type be ordered and hashed? Maps and variants cannot."""
    return not contains(data_type, T.MapType, T.VariantType)


def build_schema(columns: Iterable[tuple[str, Any]]) -> T.StructType:
    """Schema from (name, declared type) pairs; unknown declared types raise ``ValueError``."""
    fields = []
    for name, declared in columns:
        if declared not in DECLARED_TYPES:
            raise ValueError(f"no column type for declared type {declared!r} of {name}")
        fields.append(T.StructField(name, DECLARED_TYPES[declared]))
    return T.StructType(fields)


def infer_schema(spark: SparkSession, columns: Sequence[str], sample: Sequence[Any]) -> T.StructType:
    """Schema from the column names and one sample row."""
    return spark.createDataFrame([tuple(sample)], list(columns)).schema


def infer_json_schema(rows: DataFrame, text: str) -> T.StructType:
    """The schema of JSON objects in a text column, merged over all rows by an aggregate.

    A field that is missing or null in some rows has the type of the others; whole and broken numbers
    become doubles together; a field that is null everywhere, or of types that do not merge, is
    kept as text. Texts that are no JSON, and JSON that is no object, say nothing about columns.
    """
    parsed = F.try_parse_json(F.col(f"`{text}`"))
    objects = rows.select(parsed.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT<"))
    found = objects.agg(F.schema_of_variant_agg("v")).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return T.StructType()
    return _declared(T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<").replace(": VOID", ": STRING").replace("VARIANT", "STRING")))


def _declared(kind: T.DataType) -> T.DataType:
    """Merged numbers with a fraction as doubles, at every level."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _declared(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_declared(kind.elementType))
    return T.DoubleType() if isinstance(kind, T.DecimalType) else kind


def type_family(data_type: T.DataType, decimals: str = "keep") -> str:
    """The name under which two column types count as the same when loading into a target."""
    if isinstance(data_type, _INTEGERS):
        return "int64"
    if isinstance(data_type, _FLOATS):
        return "float64"
    if isinstance(data_type, T.DecimalType):
        if data_type.scale == 0:
            return "int64"
        return "float64" if decimals == "double" else data_type.simpleString()
    if isinstance(data_type, _STRINGS):
        return "string"
    if isinstance(data_type, _TIMESTAMPS):
        return "timestamp"
    return data_type.simpleString()


def schemas_compatible(a: T.StructType, b: T.StructType, decimals: str = "double") -> bool:
    """Same column names with the same type families, in any order."""
    def families(schema: T.StructType) -> dict[str, str]:
        return {f.name: type_family(f.dataType, decimals) for f in schema.fields}

    return families(a) == families(b)


def _normalised(field: T.StructField, decimals: str, naive_tz: str, ntz: str, nested: str) -> Column:
    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, _INTEGERS):
        out = col if isinstance(kind, T.LongType) else col.cast("bigint")
    elif isinstance(kind, _FLOATS):
        out = col if isinstance(kind, T.DoubleType) else col.cast("double")
    elif isinstance(kind, T.DecimalType) and decimals == "double":
        out = col.cast("double")
    elif isinstance(kind, (T.CharType, T.VarcharType, T.NullType)):
        out = col.cast("string")
    elif isinstance(kind, T.TimestampNTZType) and ntz == "instant":
        seconds = F.extract(F.lit("SECOND"), col)
        day = (F.year(col), F.month(col), F.dayofmonth(col))
        out = F.make_timestamp_ltz(*day, F.hour(col), F.minute(col), seconds, F.lit(naive_tz))
    elif kind.typeName() == "time":
        out = col.cast("string")
    elif kind.typeName() == "variant" or (isinstance(kind, _NESTED) and nested == "json"):
        out = F.to_json(col)
    else:
        out = col
    return out.alias(field.name)


def normalise(
    df: DataFrame,
    decimals: str = "keep",
    ntz: str = "keep",
    naive_tz: str = "UTC",
    nested: str = "keep",
) -> DataFrame:
    """Bring every column to its family type in one projection.

    Integers widen to ``bigint``, floats to ``double``, char/varchar/void/time become
    strings. ``decimals='double'`` turns decimals into doubles; ``ntz='instant'``
    reads naive timestamps as wall clocks of ``naive_tz``; ``nested='json'`` serialises
    arrays, maps and structs, as sinks without nested types need.
    """
    columns = [_normalised(f, decimals, naive_tz, ntz, nested) for f in df.schema.fields]
    return df.select(*columns)
