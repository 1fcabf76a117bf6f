"""Deduplication and upsert by primary key.

Plan shape: the target is anti-joined with the distinct stage keys and the stage is
appended. A stage whose keys fit the broadcast threshold leaves the target unshuffled;
otherwise both sides hash on the key and AQE splits a skewed target partition. Rows
with a NULL key match nothing, so they are spread by a hash of their other columns
instead of meeting in one partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.errors import DestinationStreamInvalidSchema, DuplicateKeys
from tablesync.functions.sizing import measure
from tablesync.functions.types import comparable
from tablesync.operators.extract import column

SPREAD = 1024

#: A stage known to be no longer than this has its keys counted in one task, which spares two shuffles.
ONE_TASK_ROWS = 100_000


def any_null(keys: Sequence[str]) -> Column:
    return reduce(or_, [column(k).isNull() for k in keys])


def none_null(keys: Sequence[str]) -> Column:
    return reduce(and_, [column(k).isNotNull() for k in keys])


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The non-NULL keys of ``df``, once each (combined map-side before the shuffle)."""
    return df.select(*[column(k) for k in keys]).where(none_null(keys)).distinct()


def _total_order(df: DataFrame, keys: Sequence[str], cursor: str | None) -> list[Column]:
    """Newest cursor first, then every other column, so ties never depend on the plan."""
    first = [column(cursor).desc_nulls_last()] if cursor else []
    rest = [f for f in df.schema.fields if f.name not in {*keys, cursor}]
    ties = [
        (column(f.name) if comparable(f.dataType) else F.to_json(column(f.name))).asc_nulls_last()
        for f in rest
    ]
    return (first + ties) or [column(keys[0]).asc()]


def dedupe_latest(
    df: DataFrame, keys: Sequence[str], cursor: str | None = None, order: Sequence[Column] | None = None
) -> DataFrame:
    """One row per key: the newest cursor, ties broken by the remaining columns in order.

    ``row_number() = 1`` lets Spark keep one row per key and map task before the
    shuffle, so a key with very many copies never fills one task. Rows with a NULL key
    are not copies of each other and all stay.
    """
    window = Window.partitionBy(*[column(k) for k in keys]).orderBy(*(order or _total_order(df, keys, cursor)))
    keyed = df.where(none_null(keys))
    latest = keyed.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")
    if not any(df.schema[k].nullable for k in keys):
        return latest
    return latest.unionByName(df.where(any_null(keys)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    counted = df.where(none_null(keys)).groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1")


def gathered(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` in one partition if it is known to have few rows, else as it is."""
    return df.coalesce(1) if rows is not None and rows <= ONE_TASK_ROWS else df


def surplus_rows(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> int:
    """Rows beyond the first of each key, 0 if keys are unique; moves only keys, counted map-side."""
    df = gathered(df.select(*[column(k) for k in keys]), rows)
    extra = duplicate_keys(df, keys).agg(F.sum(F.col("n") - 1)).first()[0]
    return int(extra or 0)


def dedupe_sparse(df: DataFrame, keys: Sequence[str], cursor: str | None = None) -> DataFrame:
    """:func:`dedupe_latest` for stages on disk whose keys are nearly unique, as keys should be.

    Counting rows per key moves only the keys. If none repeats, the rows stay where they
    are; if few repeat, only their rows are shuffled; otherwise all are.
    """
    repeated = duplicate_keys(df, keys).select(*[column(k) for k in keys])
    n, small = measure(repeated)
    if n == 0:
        return df
    if not small:
        return dedupe_latest(df, keys, cursor)
    once = df.join(F.broadcast(repeated), list(keys), "left_anti").select(*[column(c) for c in df.columns])
    many = df.join(F.broadcast(repeated), list(keys), "left_semi").select(*[column(c) for c in df.columns])
    return once.unionByName(dedupe_latest(many, keys, cursor))


def prepare_stage(stage: DataFrame, keys: Sequence[str], cursor: str | None, dedupe: str = "latest") -> DataFrame:
    """Apply the duplicate policy.

    ``latest`` keeps one row per key, ``sparse`` does the same for a stage on disk whose
    keys rarely repeat, ``none`` keeps all, ``error`` refuses repeated keys.
    """
    if dedupe == "none":
        return stage
    if dedupe == "latest":
        return dedupe_latest(stage, keys, cursor)
    if dedupe == "sparse":
        return dedupe_sparse(stage, keys, cursor)
    if dedupe == "error":
        sample = duplicate_keys(stage, keys).limit(3).collect()
        if sample:
            raise DuplicateKeys(f"stage holds repeated keys, e.g. {[tuple(r)[:-1] for r in sample]}")
        return stage
    raise ValueError(f"unknown duplicate policy: {dedupe}")


def _aligned(target: DataFrame, stage: DataFrame) -> DataFrame:
    if set(target.columns) != set(stage.columns):
        raise DestinationStreamInvalidSchema(
            f"stage columns {sorted(stage.columns)} differ from target columns {sorted(target.columns)}"
        )
    if [(f.name, f.dataType) for f in target.schema] == [(f.name, f.dataType) for f in stage.schema]:
        return stage
    return stage.select(*[column(n).cast(target.schema[n].dataType).alias(n) for n in target.columns])


def unmatched(target: DataFrame, stage: DataFrame, keys: Sequence[str], unique: bool = False) -> DataFrame:
    """Target rows whose key is not staged; rows with a NULL key always stay.

    Stage keys are made distinct first (map-side, then by key), unless they are known to
    be ``unique``.

    The helper column repeats the key hash, except on NULL-key rows of the target, where
    it is a hash of the other columns: those rows land anywhere and meet nothing.
    """
    key_hash = F.pmod(F.xxhash64(*[column(k) for k in keys]), F.lit(SPREAD))
    others = [column(f.name) for f in target.schema.fields if f.name not in keys and comparable(f.dataType)]
    others = others or [F.lit(0)]
    row_hash = F.pmod(F.xxhash64(*others), F.lit(SPREAD))
    left = target.withColumn("__spread", F.when(any_null(keys), row_hash).otherwise(key_hash))
    right = stage.where(none_null(keys)).select(*[column(k) for k in keys], key_hash.alias("__spread"))
    right = right if unique else right.distinct()
    return left.join(right, [*keys, "__spread"], "left_anti").select(*[column(n) for n in target.columns])


def not_older(target: DataFrame, stage: DataFrame, keys: Sequence[str], cursor: str) -> DataFrame:
    """Stage rows that are at least as new as the target row of their key.

    Only key and cursor are read from the target, reduced to the keys of the stage by a
    semi join, so the second join is no larger than the stage. A missing cursor is
    older than any other.
    """
    narrow = target.select(*[column(k) for k in keys], column(cursor).alias("__seen"))
    seen = (
        narrow.join(distinct_keys(stage, keys), list(keys), "left_semi")
        .groupBy(*[column(k) for k in keys])
        .agg(F.max("__seen").alias("__seen"))
    )
    keyed = stage.where(none_null(keys)).join(seen, list(keys), "left")
    fresh = keyed.where(F.col("__seen").isNull() | (column(cursor) >= F.col("__seen")))
    fresh = fresh.select(*[column(n) for n in stage.columns])
    return fresh.unionByName(stage.where(any_null(keys)))


def upsert_replace(
    target: DataFrame,
    stage: DataFrame,
    keys: Sequence[str],
    guard: str = "none",
    cursor: str | None = None,
    dedupe: str = "none",
    unique: bool = False,
) -> DataFrame:
    """Matched rows are replaced as a whole, unmatched stage rows are added.

    ``guard='cursor'`` replaces a row only by one that is not older, which makes
    replays and late batches safe in any order. ``dedupe`` is the policy of
    :func:`prepare_stage`; ``unique`` tells that no stage key repeats. Without guard the
    anti join reads only the keys of the raw stage, so the deduplication runs once, for
    the appended rows.
    """
    raw = _aligned(target, stage)
    rows = prepare_stage(raw, keys, cursor, dedupe)
    if guard == "none":
        return unmatched(target, raw, keys, unique).unionByName(rows)
    if guard != "cursor":
        raise ValueError(f"unknown guard: {guard}")
    if cursor is None:
        raise ValueError("guard='cursor' needs the cursor column")
    fresh = not_older(target, rows, keys, cursor)
    return unmatched(target, fresh, keys, unique).unionByName(fresh)


def upsert_delete_insert(target: DataFrame, stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete every target row whose key is staged, then insert the whole stage, copies included."""
    return upsert_replace(target, stage, keys)


def merge_into(stage: DataFrame, table: str, keys: Sequence[str], guard: str = "none", cursor: str | None = None) -> None:
    """The same upsert as one ``MERGE`` of a catalog table whose format supports it; the table's format commits it.

    The stage's keys must be unique. NULL keys match nothing and are inserted.
    """
    name = "stage"
    on = reduce(and_, [F.col(f"{table}.{k}") == F.col(f"{name}.{k}") for k in keys])
    newer = F.col(f"{name}.{cursor}") >= F.col(f"{table}.{cursor}") if guard == "cursor" else None
    matched = stage.alias(name).mergeInto(table, on)
    matched = matched.whenMatched(newer).updateAll() if newer is not None else matched.whenMatched().updateAll()
    matched.whenNotMatched().insertAll().merge()
