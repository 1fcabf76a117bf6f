"""The sink contract: write every stream of a dataset, then prove what was loaded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablesync.dataset import Dataset, Stream
from tablesync.errors import DestinationError, IntegrityCheckFailed
from tablesync.operators.integrity import batch_count
from tablesync.progress import Listener, Progress, report
from tablesync.spec import Mode
from tablesync.workspace import in_parallel


def refuse_shared_targets(keys: Sequence[str]) -> None:
    """Raise, before anything is written, if two streams would be written to one target."""
    shared = sorted({k for k in keys if keys.count(k) > 1})
    if shared:
        raise DestinationError(f"several streams would be written to one target: {shared}")


class Sink:
    """A place streams are written to.

    ``config`` may hold ``connect``, ``mode``, ``batch_size`` (rows per file),
    ``parquet`` options and ``drop_after_complete`` (a trial run: load, then drop).
    Subclasses implement :meth:`write_stream`; those that can read back what they
    wrote implement :meth:`target`.
    """

    label = "sink"
    part_of_compound = False

    #: Does a write evaluate the stream exactly once? Then it need not be staged first.
    single_pass = False

    def __init__(self, spark: SparkSession, config: Mapping[str, Any] | None = None):
        self.spark = spark
        self.config = dict(config or {})
        self.connect = dict(self.config.get("connect") or {})
        self.mode = Mode.coerce(self.config.get("mode"))
        self.trial = bool(self.config.get("drop_after_complete", False))
        self.written: dict[str, int] = {}

    def entity(self, dataset: Dataset, stream: Stream) -> str:
        spec = stream.spec
        return f"destination+{self.label}://{dataset.namespace}/{spec.schema_name}/{spec.name}"

    def skips_empty(self, stream: Stream) -> bool:
        """Leave the target untouched when nothing was read; a full refresh empties it instead."""
        return self.mode.incremental or self.connect.get("on_empty") == "skip"

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        raise NotImplementedError

    def target(self, stream: Stream, dataset: Dataset) -> DataFrame | None:
        """What the target holds now, or None if it cannot be read back."""
        return None

    def missing(self, stream: Stream, dataset: Dataset) -> bool:
        """Is there certainly no target of this stream yet? False where that cannot be known."""
        return self.checkable and self.target(stream, dataset) is None

    def place(self, stream: Stream, dataset: Dataset) -> str:
        """Where a stream goes; streams of one place are written one after the other."""
        return stream.spec.qualified_name

    def target_key(self, stream: Stream, dataset: Dataset) -> str:
        """What two streams must not have in common, as one would replace the other."""
        return self.place(stream, dataset)

    def loaded_rows(self, stream: Stream, dataset: Dataset, target: DataFrame) -> int:
        """Rows of this run's batch that the target holds for a stream."""
        return batch_count(target, dataset.ctx.batch_id, dataset.ctx.column("batch_id"))

    def finish(self, stream: Stream, dataset: Dataset) -> None:
        """Remove what a trial run wrote for one stream."""

    def _observed(self, stream: Stream) -> tuple[Stream, Observation]:
        """The stream with its rows counted while they are written, in the last stage of that job."""
        seen = Observation()
        return replace(stream, df=stream.df.observe(seen, F.count(F.lit(1)).alias("n"))), seen

    def write(self, dataset: Dataset, on_progress: Listener | None = None) -> dict[str, dict]:
        """Write all streams; returns the progress summary of each by entity.

        A stream that was not staged goes to a single-pass sink directly and is counted
        on the way; other sinks count it first. ``config['parallel']`` streams are
        written at a time.
        """
        streams = list(dataset.in_schema(self.connect.get("target_schema")))
        targets = [self.place(s, dataset) for s in streams]
        refuse_shared_targets([self.target_key(s, dataset) for s in streams])
        workers = int(self.config.get("parallel", 1)) if len(set(targets)) == len(targets) else 1
        try:
            one = lambda s: self._write_one(s, dataset, on_progress)
            return dict(in_parallel(self.spark, one, streams, workers))
        finally:
            if self.trial and not self.part_of_compound:
                self.clean(dataset)

    def _write_one(self, stream: Stream, dataset: Dataset, on_progress) -> tuple[str, dict]:
        entity = self.entity(dataset, stream)
        if stream.rows is None and self.single_pass:
            observed, seen = self._observed(stream)
            begun = report(Progress(entity), on_progress)
            self.write_stream(observed, dataset)
            # a plan that is empty for certain may be written without being observed
            rows = self.written[entity] = int(seen.get.get("n", 0))
            done = begun.later(rows, "written", total=rows)
        else:
            rows = self.written[entity] = dataset.size(stream)
            begun = report(Progress(entity, total=rows), on_progress)
            if rows == 0 and self.skips_empty(stream):
                done = begun.later(0, "nothing to write")
            else:
                self.write_stream(stream, dataset)
                done = begun.later(rows, "written")
        return entity, report(done, on_progress).summary()

    def clean(self, dataset: Dataset) -> None:
        """Remove what a trial run wrote."""
        for stream in dataset.in_schema(self.connect.get("target_schema")):
            self.finish(stream, dataset)

    def check(self, dataset: Dataset) -> dict[str, int]:
        """Batch volume of every stream against the target; empty streams count 0 = 0."""
        loaded = {}
        marker = dataset.ctx.column("batch_id")
        for stream in dataset.in_schema(self.connect.get("target_schema")):
            name, entity = stream.spec.qualified_name, self.entity(dataset, stream)
            expected = self.written[entity] if entity in self.written else dataset.size(stream)
            target = self.target(stream, dataset)
            if target is None:
                if expected and self.checkable:
                    raise IntegrityCheckFailed(f"batch volume of {name} differs: no target, expected {expected}")
                continue
            if marker not in target.columns:
                continue
            expected = self.expected_rows(stream, expected)
            loaded[name] = self.loaded_rows(stream, dataset, target)
            if expected is not None and loaded[name] != expected:
                raise IntegrityCheckFailed(
                    f"batch volume of {name} differs: loaded {loaded[name]}, expected {expected}"
                )
        return loaded

    #: Does a missing target mean that rows were lost?
    checkable = False

    def expected_rows(self, stream: Stream, staged: int) -> int | None:
        """Rows of the batch the target should hold, None if that cannot be known in advance."""
        return staged
