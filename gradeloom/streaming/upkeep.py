"""Regular upkeep and progress of streams, and snapshots that grow old."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gradeloom.operators import cache


class Progress(StreamingQueryListener):
    """Collects what streams report: started, rows of each batch, ended."""

    def __init__(self, most: int = 1_000):
        self.events, self.most = [], most

    def _put(self, **event) -> None:
        self.events = [*self.events[1 - self.most :], event]

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._put(kind="started", name=event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._put(kind="progress", batch=event.progress.batchId, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._put(kind="ended", error=event.exception)


def upkeep(spark: SparkSession, ticks: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, **limits) -> StreamingQuery:
    """For each batch of ticks (a stream with a column now, in milliseconds) the entries that read() gives are pruned and handed to
    write(), which must not overwrite what read() still reads."""

    def once(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max("now")).first()[0]
        if now is not None:
            write(cache.maintained(read(), int(now), **limits))

    return ticks.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Snapshot:
    """A DataFrame that is kept in memory for a while, then read anew."""

    def __init__(self, read: Callable[[], DataFrame], seconds: float = 30, clock: Callable[[], float] = time.monotonic):
        self.read, self.seconds, self.clock = read, seconds, clock
        self.at, self.held = None, None

    def get(self) -> DataFrame:
        if self.held is None or self.clock() - self.at > self.seconds:
            if self.held is not None:
                self.held.unpersist()
            self.at, self.held = self.clock(), self.read().persist()
        return self.held
