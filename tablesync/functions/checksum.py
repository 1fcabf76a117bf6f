"""Row checksums computed by Spark expressions, without a Python worker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain_number(text: Column) -> Column:
    """Rewrite the JVM's scientific notation the way Python prints floats.

    Both print the plain form for 1e-3 <= |x| < 1e7. Beyond that the JVM always uses
    ``d.dddE±x``; Python stays positional for 1e-4 <= |x| < 1e16.
    """
    sign = F.when(text.startswith("-"), "-").otherwise("")
    unsigned = F.regexp_replace(text, "^-", "")
    exponent = F.split_part(unsigned, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.split_part(unsigned, F.lit("E"), F.lit(1)), r"\.0$|\.", "")
    size = F.length(digits)

    whole = F.when(
        size <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0"))
    ).otherwise(F.concat_ws(".", F.substring(digits, F.lit(1), exponent + 1), F.substring(digits, exponent + 2, size)))
    small = F.concat(F.lit("0.000"), digits)
    mantissa = F.when(size == 1, digits).otherwise(
        F.concat_ws(".", F.substring(digits, 1, 1), F.substring(digits, F.lit(2), size))
    )
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
    )
    rewritten = (
        F.when(exponent.between(0, 15), whole).when(exponent == -4, small).otherwise(scientific)
    )
    return F.when(text.contains("E"), F.concat(sign, rewritten)).otherwise(text)


def rendered(name: str, data_type: T.DataType) -> Column:
    """A column as the text that enters the checksum; NULL is the word ``None``."""
    col = F.col(f"`{name}`")
    if isinstance(data_type, T.BooleanType):
        text = F.when(col, "True").otherwise("False")
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        zone = "+00:00" if isinstance(data_type, T.TimestampType) else ""
        micros = F.date_format(col, "SSSSSS")
        text = F.concat(
            F.date_format(col, "yyyy-MM-dd HH:mm:ss"),
            F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
            F.lit(zone),
        )
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        text = (
            F.when(F.isnan(col), "nan")
            .when(col == float("inf"), "inf")
            .when(col == float("-inf"), "-inf")
            .otherwise(_plain_number(col.cast("string")))
        )
    elif isinstance(data_type, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"column {name} of type {data_type.simpleString()} needs checksum='v2'")
    else:
        text = col.cast("string")
    return F.when(col.isNull(), "None").otherwise(text)


def row_checksum(df: DataFrame, kind: str | bool = "compat", columns: Sequence[str] | None = None) -> Column:
    """Checksum over the raw columns of ``df``.

    ``compat``: MD5 hex of the rendered values joined without separator, which
    equals what existing targets hold but maps (1, 23) and (12, 3) to one value.
    ``v2``: SHA-256 of the row as JSON, free of that ambiguity.
    """
    names = list(columns) if columns is not None else df.columns
    if kind in (True, "compat"):
        return F.md5(F.concat(*[rendered(n, df.schema[n].dataType) for n in names]).cast("binary"))
    if kind == "v2":
        return F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])), 256)
    raise ValueError(f"unknown checksum kind: {kind}")
