"""Decisions that depend on how big an input really is."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.types import comparable

#: Bounds of a side that is broadcast by hint, checked by counting.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def _row_bytes(schema: T.StructType) -> Column:
    """Bytes of a row: the length of texts and binaries, 16 for every other value."""
    sizes = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16
        if isinstance(f.dataType, (T.StringType, T.BinaryType))
        else F.lit(16)
        for f in schema.fields
    ]
    return reduce(add, sizes)


def measure(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> tuple[int, bool]:
    """Rows of ``df``, and whether it fits both bounds; a plain aggregate, so only sums leave a task."""
    n, total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df.schema)).alias("bytes")).first()
    return n, n <= max_rows and (total or 0) <= max_bytes


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Does ``df`` fit both bounds?"""
    return measure(df, max_rows, max_bytes)[1]


def broadcast_if_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only of a side whose size was counted and fits the bounds.

    A larger side is returned unhinted: the join shuffles, with AQE splitting hot keys.
    Meant for narrow sides such as a recipient list.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


#: A read below this estimate has so few tasks that their files need no gathering.
GATHER_ABOVE_BYTES = 1024 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a plan's size; for a filtered scan without statistics, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of all that a plan reads; what it cannot estimate, such as rows of the driver, counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def clustered_for_write(df: DataFrame) -> DataFrame:
    """Gather the rows of a selective read of many files into few files of the advisory size."""
    return df.hint("rebalance") if estimated_bytes(df) > GATHER_ABOVE_BYTES else df


#: Rows of one folder that one write task takes before the folder is split.
ROWS_PER_WRITER = 2_000_000

#: A write below this estimate is not worth counting its folders first.
SMALL_WRITE_BYTES = 128 * 1024 * 1024

#: No more than this many folders are split explicitly; see :func:`spread_for_write`.
MAX_SPLIT_FOLDERS = 10_000


def spread_for_write(df: DataFrame, by: str, counts: DataFrame, rows_per_writer: int = ROWS_PER_WRITER) -> DataFrame:
    """Arrange rows for a write partitioned by ``by``: small folders whole, large ones over many tasks.

    ``counts`` holds ``by`` and (about) how many rows each folder gets, ``n``. A folder
    above the limit is salted with a hash of its rows into one piece per
    ``rows_per_writer`` rows, so it neither fills one task nor scatters the folders it
    would share a partition with. Only folders above 1/10,000 of all rows are listed,
    of which there are fewer than 10,000, so the list is always small; AQE splits what
    lies below. A write that is small as a whole is arranged without counting.
    """
    if estimated_bytes(df) <= SMALL_WRITE_BYTES:
        return df.hint("rebalance", by)
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(rows_per_writer, (total or 0) // MAX_SPLIT_FOLDERS)
    if (most or 0) <= limit:
        return df.hint("rebalance", by)
    large = counts.where(F.col("n") > limit).select(by, F.ceil(F.col("n") / rows_per_writer).alias("__pieces"))
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if comparable(f.dataType)]
    piece = F.when(F.col("__pieces").isNotNull(), F.pmod(F.xxhash64(*hashed), F.col("__pieces"))).otherwise(F.lit(0))
    salted = df.join(F.broadcast(large), by, "left").withColumn("__piece", piece)
    arranged = salted.hint("rebalance", by, "__piece")
    return arranged.select(*[F.col(f"`{c}`") for c in df.columns])
