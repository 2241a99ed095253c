"""Progress of streams for a caller's function; what it raises never reaches the stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls ``told(event, facts)`` for starts, batches and ends; counts what the function raised."""

    def __init__(self, told: Callable[[str, dict], None]):
        self.told, self.failed = told, 0

    def _tell(self, event: str, **facts) -> None:
        try:
            self.told(event, facts)
        except Exception:  # an observer must not stop what it observes
            self.failed += 1

    def onQueryStarted(self, event) -> None:
        self._tell("started", id=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell("progress", id=str(p.id), batch=p.batchId, rows=p.numInputRows, rows_a_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        self._tell("idle", id=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self._tell("ended", id=str(event.id), error=event.exception)


def watch(spark: SparkSession, told: Callable[[str, dict], None]) -> Progress:
    listener = Progress(told)
    spark.streams.addListener(listener)
    return listener
