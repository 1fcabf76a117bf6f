"""What moves between a source and a sink: named streams over lazy DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from tablesync.spec import Mode, StreamSpec, SyncContext


@dataclass(frozen=True)
class Stream:
    """One stream of a dataset. ``rows`` is known once the stream was staged."""

    spec: StreamSpec
    df: DataFrame
    rows: int | None = None

    def retarget(self, schema_name: str | None = None, name: str | None = None) -> Stream:
        return replace(self, spec=self.spec.retarget(schema_name, name))


@dataclass(frozen=True)
class Dataset:
    """The streams of one source read in one run, under one batch id and sync time."""

    namespace: str
    streams: tuple[Stream, ...]
    ctx: SyncContext
    mode: Mode = field(default_factory=Mode.full)

    def __iter__(self) -> Iterator[Stream]:
        return iter(self.streams)

    def stream(self, name: str, schema_name: str | None = None) -> Stream:
        for s in self.streams:
            if s.spec.name == name and schema_name in (None, s.spec.schema_name):
                return s
        raise KeyError(name)

    def size(self, stream: Stream) -> int:
        """Exact row count; counts the stream if it was not staged."""
        return stream.rows if stream.rows is not None else stream.df.count()

    def rename_stream(self, name: str, schema_name: str, new_name: str, new_schema: str) -> Dataset:
        """A dataset in which one stream is written under another name."""
        self.stream(name, schema_name)
        return replace(
            self,
            streams=tuple(
                s.retarget(new_schema, new_name) if (s.spec.name, s.spec.schema_name) == (name, schema_name) else s
                for s in self.streams
            ),
        )

    def in_schema(self, schema_name: str | None) -> Dataset:
        """A dataset whose streams are all written into one target schema."""
        if not schema_name:
            return self
        return replace(self, streams=tuple(s.retarget(schema_name) for s in self.streams))
