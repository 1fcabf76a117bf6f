"""Read a source once: the staged snapshot all sinks and checks of a run share."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablesync.dataset import Dataset, Stream
from tablesync.functions.sizing import clustered_for_write
from tablesync.progress import Progress, report
from tablesync.workspace import Folder, fresh_folder, in_parallel


def stage_snapshot(df: DataFrame, path: str, compact: bool = False) -> tuple[DataFrame, int]:
    """Write ``df`` once and return it read back, with its exact row count.

    The count is observed in the writing job itself, in its last stage, where Spark
    counts the rows of a retried task once. ``compact`` gathers the rows of a selective
    read into few files; a full refresh needs no shuffle.
    """
    seen = Observation()
    rows = clustered_for_write(df) if compact else df
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    n = seen.get.get("n") if seen.get else None
    return staged, staged.count() if n is None else int(n)


def stage_dataset(dataset: Dataset, folder: str | None = None, parallel: int = 4, on_progress=None) -> Dataset:
    """Stage every stream; independent streams run as concurrent Spark jobs."""
    if not dataset.streams:
        return dataset
    spark = dataset.streams[0].df.sparkSession
    root = folder or fresh_folder(spark, f"stage-{dataset.ctx.batch_id}")

    def stage(numbered: tuple[int, Stream]) -> Stream:
        i, stream = numbered
        path = f"{root}/{i:03d}-{stream.spec.folder}"
        df, rows = stage_snapshot(stream.df, path, compact=dataset.mode.incremental)
        spec = stream.spec
        entity = f"source+{dataset.namespace}://{dataset.namespace}/{spec.schema_name}/{spec.name}"
        report(report(Progress(entity, total=rows), on_progress).later(rows, "staged"), on_progress)
        return replace(stream, df=df, rows=rows)

    return replace(dataset, streams=tuple(in_parallel(spark, stage, enumerate(dataset.streams), parallel)))


def drop_stage(spark, folder: str) -> None:
    Folder(spark, folder).remove()
