"""Checks after a load: batch volume, missing parents, rows of foreign tenants."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.errors import IntegrityCheckFailed
from tablesync.operators.extract import column


def batch_count(target: DataFrame, batch_id: str, batch_column: str = "sync__batch_id") -> int:
    """Rows of one batch in the target."""
    return target.where(column(batch_column) == F.lit(batch_id)).count()


def check_batch_volume(
    target: DataFrame, batch_id: str, expected: int, batch_column: str = "sync__batch_id", name: str = "stream"
) -> int:
    """Compare loaded with staged rows; raises if they differ, returns the loaded count."""
    loaded = batch_count(target, batch_id, batch_column)
    if loaded != expected:
        raise IntegrityCheckFailed(f"batch volume of {name} differs: loaded {loaded}, expected {expected}")
    return loaded


def batch_volumes(target: DataFrame, staged: DataFrame, batch_column: str = "sync__batch_id") -> DataFrame:
    """Loaded against staged rows for every batch on either side, with a verdict."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(column(batch_column).alias("batch_id")).agg(F.count(F.lit(1)).alias(name))

    loaded, expected = F.coalesce("loaded", F.lit(0)), F.coalesce("expected", F.lit(0))
    return (
        counts(target, "loaded")
        .join(counts(staged, "expected"), "batch_id", "full_outer")
        .select("batch_id", loaded.alias("loaded"), expected.alias("expected"), (loaded == expected).alias("ok"))
    )


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child keys without parent and how many rows carry each; NULL keys have no parent.

    Children are counted per key first, so a key shared by very many rows enters the
    join once.
    """
    keys = list(on)
    per_key = child.groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(*[column(p).alias(c) for c, p in on.items()])
    return per_key.join(parents, keys, "left_anti")


def check_referential(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """One row with the number of child rows whose parent is missing (``orphans``)."""
    return orphans(child, parent, on).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphans"))


def foreign_rows(rows: DataFrame, tenant_column: str, allowed: Sequence[Any]) -> DataFrame:
    """Rows an export must not contain: another tenant's, or without tenant."""
    tenant = column(tenant_column)
    return rows.where(tenant.isNull() | ~tenant.isin(*allowed))
