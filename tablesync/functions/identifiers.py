"""Identifier sanitising, on the driver and as a column expression."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_IDENTIFIER = 64


def _safe_part(part: str) -> str:
    return re.sub(r"^[0-9]+", "", re.sub(r"\W+", "_", part))[:MAX_IDENTIFIER]


def _valid(part: str) -> bool:
    return bool(part) and (part[0] == "_" or (part[0].isascii() and part[0].isalpha()))


def safe_identifier(name: str, default: str | None = None) -> str:
    """Sanitise each dotted part; an unusable part becomes ``default`` or raises ``ValueError``."""
    parts = [_safe_part(p) for p in name.split(".")]
    if default is not None:
        parts = [p if _valid(p) else default for p in parts]
    if not all(map(_valid, parts)):
        raise ValueError(f"not usable as an identifier: {name!r}")
    return ".".join(parts)


def derived_identifier(name: str, suffix: str) -> str:
    """``name`` with a suffix that survives the greatest length: a long last part is cut and marked by its hash."""
    name = safe_identifier(name)
    head, _, last = name.rpartition(".")
    if len(last) + len(suffix) > MAX_IDENTIFIER:
        mark = hashlib.md5(f"{last}{suffix}".encode()).hexdigest()[:8]
        suffix = suffix if len(suffix) <= 24 else suffix[:24]
        last = f"{last[: MAX_IDENTIFIER - len(suffix) - len(mark) - 1]}_{mark}"
    return f"{head}.{last}{suffix}" if head else f"{last}{suffix}"


def safe_identifier_column(name: Column, default: str | None = None) -> Column:
    """Column form of :func:`safe_identifier`; names without a usable form become NULL."""
    def clean(part: Column) -> Column:
        word = F.regexp_replace(part, r"(?U)\W+", "_")
        word = F.substring(F.regexp_replace(word, "^[0-9]+", ""), 1, MAX_IDENTIFIER)
        return F.when(word.rlike("^[A-Za-z_]"), word).otherwise(F.lit(default).cast("string"))

    parts = F.transform(F.split(name, r"\."), clean)
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.array_join(parts, "."))


def with_safe_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its sanitised form (dots in column names count as separators)."""
    return df.toDF(*[safe_identifier(c).replace(".", "_") for c in df.columns])
