"""What Parquet footers know: counts and bounds of whole tables, codecs and rows of every file."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.operators.extract import column


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the plans that are made inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def footer_counts(spark: SparkSession, path: str, *bounds: str) -> DataFrame:
    """``n`` rows of a Parquet table, and ``min_<c>``, ``max_<c>`` of ``bounds``, from footers where they know.

    The V2 source answers an unfiltered ``count``, ``min`` and ``max`` of numbers, booleans and dates from the
    statistics of the row groups, so no data page is read. Texts and timestamps have no usable bounds there;
    Spark then reads those columns, with the same result.
    """
    v1 = [x for x in spark.conf.get("spark.sql.sources.useV1SourceList", "").split(",") if x and x != "parquet"]
    with settings(spark, {"spark.sql.sources.useV1SourceList": ",".join(v1), "spark.sql.parquet.aggregatePushdown": "true"}):
        ends = [f(column(c)).alias(f"{name}_{c}") for c in bounds for name, f in (("min", F.min), ("max", F.max))]
        found = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), *ends)
        found._jdf.queryExecution().executedPlan()  # planned here, under these settings
    return found


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
            store, name = fs.FileSystem.from_uri(uri)
            with store.open_input_file(name) as file:
                meta = pq.read_metadata(file)
            groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
            codecs = sorted({g.column(j).compression for g in groups for j in range(g.num_columns)})
            rows.append((path, meta.num_rows, len(groups), codecs))
        names = ["path", "n_rows", "row_groups", "codecs"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def file_footers(spark: SparkSession, path: str) -> DataFrame:
    """One row per Parquet file below ``path``: ``path``, ``n_rows``, ``row_groups``, ``codecs``; footers are read by the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path").mapInArrow(_footers, "path string, n_rows long, row_groups int, codecs array<string>")
