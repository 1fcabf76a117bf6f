"""Preview of a dataset on the console."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from tablesync.dataset import Dataset, Stream
from tablesync.sinks.base import Sink

DEFAULT_LIMIT = 100


def preview(df: DataFrame, n: int = DEFAULT_LIMIT, order: Sequence[Column | str] = ()) -> DataFrame:
    """The first ``n`` rows, under an order if one is stated."""
    return (df.orderBy(*order) if order else df).limit(n)


class ConsoleSink(Sink):
    """Prints namespace, schema and the first ``connect.limit`` rows of each stream."""

    label = "console"

    def entity(self, dataset: Dataset, stream: Stream) -> str:
        return f"{dataset.namespace}/{stream.spec.schema_name}/{stream.spec.name}"

    def write_stream(self, stream: Stream, dataset: Dataset) -> None:
        shown = preview(stream.df, int(self.connect.get("limit", DEFAULT_LIMIT)))
        print(f"{dataset.namespace}: {stream.spec.qualified_name}")
        print(stream.df.schema.simpleString())
        for row in shown.collect():
            print("   ", list(row))
