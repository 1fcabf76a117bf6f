"""Live progress of a running stream: every micro-batch is an observation for the caller's listener."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tablesync.progress import Listener, Progress, report

#: Name under which a feed's rows are observed.
METRIC = "tablesync_feed"


def observed_feed(feed: DataFrame, name: str = METRIC) -> DataFrame:
    """The feed, with its rows counted on the way in every micro-batch."""
    return feed.observe(name, F.count(F.lit(1)).alias("n"))


class StreamProgress(StreamingQueryListener):
    """Reports a stream's micro-batches as :class:`Progress` of one entity, in order, and remembers them.

    Rows are those that the query's :func:`observed_feed` counted; a batch that Spark reports twice is
    taken once, so a restart from the checkpoint goes on where it was. ``total`` is known to the caller or 0.
    """

    def __init__(self, entity: str, listener: Listener | None = None, total: int = 0, name: str = METRIC):
        self.entity, self.listener, self.name = entity, listener, name
        self.now = Progress(entity, total=total)
        self.batches: dict[int, int] = {}
        self._over = threading.Event()
        self._queries: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._over.clear()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        batch = event.progress.batchId
        if seen is None or not seen["n"] or batch in self.batches:
            return
        self.batches[batch] = seen["n"]
        self.now = report(self.now.later(self.now.processed + seen["n"], f"batch {batch}"), self.listener)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._over.set()

    def watch(self, query: StreamingQuery, seconds: float = 60) -> dict[int, int]:
        """Wait for the end of a query and of its reports; returns the rows of every batch."""
        query.awaitTermination()
        self._over.wait(seconds)
        return dict(self.batches)
