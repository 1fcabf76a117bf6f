"""Upsert targets in plain Parquet folders.

Below a table's root lie ``sync__parts=<n>/sync__part=<i>`` folders; a row's part is a hash of its key, so a
key never moves. An upsert merges the parts that hold staged keys and writes them with dynamic
partition overwrite: Spark stages their files and exchanges the folders when the job commits, and a
lost run leaves the table as it was. A full refresh loads a folder beside the table and renames it.
Any Parquet reader can read the table. Writers of one table must take turns; where that cannot be
had, use a table format of the session's catalog (:func:`tablesync.operators.upsert.merge_into`).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.dataset import Dataset, Stream
from tablesync.errors import DestinationError, DestinationStreamInvalidSchema
from tablesync.functions.sizing import input_bytes, spread_for_write
from tablesync.functions.types import comparable, schemas_compatible
from tablesync.operators.extract import column
from tablesync.operators.upsert import any_null, gathered, prepare_stage, surplus_rows, upsert_replace
from tablesync.sinks.base import Sink
from tablesync.workspace import Folder, written

PARTS, PART = "sync__parts", "sync__part"

#: Up to this share of repeated rows, only the rows of repeated keys are sorted.
SPARSE_SHARE = 0.05

#: Bytes of a part at a full load; a table whose parts have grown to so many times that is cut anew by its next upsert.
PART_BYTES, GROWN = 256 * 1024 * 1024, 4

#: With this many staged rows per part, or this many touched parts, all parts are merged without naming them.
ROWS_TOUCH_ALL, MOST_NAMED = 16, 10_000


def part_of(df: DataFrame, keys: Sequence[str], parts: int) -> Column:
    """The part of a row: a hash of its key, or of the whole row where a key is NULL, as such rows match nothing."""
    whole = [column(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name) if comparable(f.dataType)]
    key = F.xxhash64(*[column(k) for k in keys])
    return F.pmod(F.when(any_null(keys), F.xxhash64(*whole)).otherwise(key), F.lit(parts)).cast("int")


class SnapshotTable:
    """A Parquet table under ``root`` with full replacement and upsert; ``parts`` (else by size) is how a full load cuts it."""

    def __init__(self, spark: SparkSession, root: str, parts: int | None = None):
        self.spark, self.root, self.cut = spark, root.rstrip("/"), parts
        self.folder = Folder(spark, self.root)
        self.known: T.StructType | None = None  # the schema, once this object has read or written the table
        self.watched: Column | None = None  # a condition; rows that meet it are counted while they are written
        self.counted: int | None = None

    def parts(self) -> int:
        """Into how many parts the table is cut, 0 if it does not exist."""
        return max((int(n.partition("=")[2]) for n in self.folder.names() if n.startswith(f"{PARTS}=")), default=0)

    def exists(self) -> bool:
        return self.parts() > 0

    def _placed(self, schema: T.StructType | None = None) -> DataFrame:
        if not self.exists():
            raise DestinationError(f"{self.root} does not exist")
        reader = self.spark.read
        if schema is not None:  # spares the job that reads a footer
            reader = reader.schema(T.StructType([*schema.fields, T.StructField(PARTS, T.IntegerType()), T.StructField(PART, T.IntegerType())]))
        return reader.parquet(self.root).drop(PARTS)

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        return self._placed(schema).drop(PART)

    def schema(self) -> T.StructType:
        return self.read().schema

    def _write(self, df: DataFrame, keys: Sequence[str], parts: int, root: str, sized_by: DataFrame | None = None) -> None:
        """Write ``df`` over the parts that it has rows of; ``sized_by`` has the part of (about) every row."""
        place = F.lit(0) if parts == 1 else part_of(df, keys, parts)
        rows = df.withColumn(PART, place) if PART not in df.columns else df
        if parts > 1:
            rows = spread_for_write(rows, PART, (rows if sized_by is None else sized_by).groupBy(PART).agg(F.count(F.lit(1)).alias("n")))
        seen = Observation()
        rows = rows.observe(seen, F.count_if(F.lit(False) if self.watched is None else self.watched).alias("n"))
        writer = rows.withColumn(PARTS, F.lit(parts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(PARTS, PART).parquet(root)
        self.counted = int(seen.get.get("n", 0)) if self.watched is not None else None

    def replace(self, df: DataFrame, keys: Sequence[str] = ()) -> None:
        """Make ``df`` the whole content; schema and cut may change. The old rows stay until the new ones are complete."""
        parts = (self.cut or max(1, math.ceil(input_bytes(df) / PART_BYTES))) if keys else 1
        load = Folder(self.spark, f"{self.root}.load-{uuid.uuid4().hex}")
        self._write(df, keys, parts, load.path)
        if not any(n.startswith(PARTS) for n in load.names()):  # no row, no folder; the schema must be kept
            self.spark.createDataFrame([], df.schema).write.parquet(f"{load.path}/{PARTS}={parts}/{PART}=0")
        load.take_place_of(self.folder)
        self.known = df.schema

    def upsert(
        self, stage: DataFrame, keys: Sequence[str], cursor: str | None = None, dedupe: str = "latest", guard: str = "none",
        on_disk: bool = False, unique: bool = False, rows: int | None = None,
    ) -> None:
        """Merge a stage by key; creates the table if it does not exist.

        ``on_disk`` tells that reading the stage again is cheap, so it is not copied;
        ``unique`` that no key of it repeats; ``rows`` how many it has.
        """
        parts = self.parts()
        if not parts:
            return self.replace(prepare_stage(stage, keys, cursor, dedupe), keys)
        if self.cut not in (None, parts):
            raise DestinationError(f"{self.root} is cut into {parts} parts, not into {self.cut}; a full refresh can change that")
        target = self._placed()
        self.known = target.drop(PART).schema
        if not schemas_compatible(stage.schema, self.known):
            raise DestinationStreamInvalidSchema(f"the existing schema of {self.root} does not match the stream")
        if (guard != "none" or parts > 1) and not (on_disk and dedupe == "none"):  # such a stage is read more than once
            stage = written(prepare_stage(stage, keys, cursor, dedupe), "stage")
            unique, dedupe = unique or dedupe != "none", "none"
        if parts == 1:
            old, place = target.drop(PART), None
        else:
            old, place = self._touched(target, stage, keys, parts, rows)
        merged = upsert_replace(old, stage, keys, guard, cursor, dedupe, unique)
        if self.cut is None and self.folder.bytes() > GROWN * PART_BYTES * parts:
            return self.replace(upsert_replace(target.drop(PART), stage, keys, guard, cursor, dedupe, unique), keys)
        self._write(merged, keys, parts, self.root, place)

    def _touched(self, target: DataFrame, stage: DataFrame, keys: Sequence[str], parts: int, rows: int | None):
        """The rows of the parts that receive staged rows, and the part of every row old and new. Part names are few by construction."""
        staged = stage.select(part_of(stage, keys, parts).alias(PART))
        if (rows or 0) < ROWS_TOUCH_ALL * parts:
            names = gathered(staged, rows).agg(F.collect_set(PART)).first()[0]
            target = target.where(F.col(PART).isin(names)) if len(names) <= MOST_NAMED else target
        own = part_of(target.drop(PART), keys, parts)
        other = F.raise_error(F.lit(f"{self.root} is cut by other keys than {list(keys)}; a full refresh can change that"))
        key, kind = column(keys[0]), target.schema[keys[0]].dataType
        checked = target.withColumn(keys[0], F.when(own == F.col(PART), key).otherwise(other.cast(kind)))
        return checked.drop(PART), target.select(PART).unionByName(staged)

    def drop(self) -> None:
        self.folder.remove()


def write_snapshot(
    df: DataFrame, path: str, incremental: bool = False, keys: Sequence[str] = (), cursor: str | None = None,
    on_empty: str = "replace", dry_run: bool = False, **options,
) -> SnapshotTable:
    """Full refresh or upsert of one table by path.

    An empty full refresh empties the table unless ``on_empty='skip'``; an empty upsert
    changes nothing. ``dry_run`` loads into a scratch table, then drops it.
    """
    table = SnapshotTable(df.sparkSession, f"{path}.trial" if dry_run else path)
    if (incremental or on_empty == "skip") and df.isEmpty():
        return table
    if incremental:
        table.upsert(df, keys, cursor, **options)
    else:
        table.replace(df)
    if dry_run:
        table.drop()
    return table


class SnapshotSink(Sink):
    """Upsert sink over :class:`SnapshotTable`: tables at ``root/schema/table``.

    ``connect``: ``root``; ``dedupe`` and ``guard`` policies; ``part_buckets``, a number of hash parts. A table
    with keys is otherwise cut by its size, and cut anew when it has outgrown that.
    """

    label = "snapshot"
    checkable = True

    def __init__(self, spark, config=None):
        super().__init__(spark, config)
        self.surplus: dict[str, int] = {}
        self.known: dict[str, T.StructType | None] = {}
        self.counted: dict[str, int] = {}
        if "part_date" in self.connect:
            raise DestinationError("tables are cut by a hash of their key; use part_buckets")

    def table(self, stream: Stream) -> SnapshotTable:
        spec = stream.spec
        path = "/".join(p for p in (self.connect["root"].rstrip("/"), spec.schema_name, spec.name) if p)
        parts = self.connect.get("part_buckets")
        return SnapshotTable(self.spark, f"{path}.trial" if self.trial else path, int(parts) if parts and spec.require_keys() else None)

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        table, spec = self.table(stream), stream.spec
        keys = spec.require_keys() if self.mode.incremental else spec.keys
        cursor = spec.cursor_field if spec.cursor_field in stream.df.columns else None
        policy, staged = self.connect.get("dedupe", "latest"), stream.rows is not None
        marker = dataset.ctx.column("batch_id")
        table.watched = column(marker) == F.lit(dataset.ctx.batch_id) if marker in stream.df.columns else None
        if keys and staged and policy == "latest":
            # keys of a sound source are unique: a count of the keys alone usually spares the sort of all rows
            surplus = self.surplus[spec.qualified_name] = surplus_rows(stream.df, keys, stream.rows)
            if surplus <= stream.rows * SPARSE_SHARE:
                policy = "sparse" if surplus else "none"
        if self.mode.incremental:
            unique, guard = self.surplus.get(spec.qualified_name) == 0, self.connect.get("guard", "none")
            table.upsert(stream.df, keys, cursor, policy, guard, on_disk=staged, unique=unique, rows=stream.rows)
        else:
            table.replace(prepare_stage(stream.df, keys, cursor, policy) if keys else stream.df, keys)
        self.known[table.root] = table.known
        if table.counted is not None:
            self.counted[table.root] = table.counted

    def loaded_rows(self, stream: Stream, dataset: Dataset, target: DataFrame) -> int:
        """Rows of the batch, counted by the write itself in its last stage; a sink that did not write them counts the target."""
        counted = self.counted.get(self.table(stream).root)
        return super().loaded_rows(stream, dataset, target) if counted is None else counted

    def expected_rows(self, stream: Stream, staged: int) -> int | None:
        spec = stream.spec
        if self.connect.get("guard", "none") != "none" and self.mode.incremental:
            return None
        if not spec.keys or not staged or self.connect.get("dedupe", "latest") == "none":
            return staged
        if spec.qualified_name not in self.surplus:
            self.surplus[spec.qualified_name] = surplus_rows(stream.df, spec.keys, staged)
        return staged - self.surplus[spec.qualified_name]

    def target(self, stream: Stream, dataset: Dataset) -> DataFrame | None:
        table = self.table(stream)
        return table.read(self.known.get(table.root)) if table.exists() else None

    def finish(self, stream: Stream, dataset: Dataset) -> None:
        self.table(stream).drop()
