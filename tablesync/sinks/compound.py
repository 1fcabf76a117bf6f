"""Several sinks fed from one dataset, in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from tablesync.dataset import Dataset
from tablesync.progress import Listener
from tablesync.sinks.base import Sink


class CompoundSink(Sink):
    """Writes the dataset to each sink in turn; the last one is the target that is checked."""

    label = "compound"

    def __init__(self, spark, config=None, sinks: Sequence[Sink] = ()):
        super().__init__(spark, config)
        if not sinks:
            raise ValueError("a compound sink needs at least one sink")
        self.sinks = list(sinks)
        for sink in self.sinks:
            sink.part_of_compound = True

    def write(self, dataset: Dataset, on_progress: Listener | None = None) -> dict[str, dict]:
        summaries = {}
        try:
            for sink in self.sinks:
                summaries |= sink.write(dataset, on_progress)
        finally:
            if self.trial and not self.part_of_compound:
                self.clean(dataset)
        return summaries

    def clean(self, dataset: Dataset) -> None:
        for sink in reversed(self.sinks):
            sink.clean(dataset)

    def target_key(self, stream, dataset: Dataset) -> str:
        return self.sinks[-1].target_key(stream, dataset)

    def missing(self, stream, dataset: Dataset) -> bool:
        return self.sinks[-1].missing(stream, dataset)

    def check(self, dataset: Dataset) -> dict[str, int]:
        return self.sinks[-1].check(dataset)


def multi_sink(*kinds: type[Sink]) -> Callable[..., CompoundSink]:
    """A constructor for a compound of sink classes that share one configuration."""
    def build(spark, config=None) -> CompoundSink:
        return CompoundSink(spark, config, [kind(spark, config) for kind in kinds])

    return build
