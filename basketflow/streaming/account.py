"""What streaming queries took in, refused and dropped, added up from their progress reports."""

import time
from collections import Counter
from threading import Lock

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import (
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
    StreamingQueryListener,
)


class Account(StreamingQueryListener):
    """Sums for each query name, over all its batches since the account was opened.

    ``input_rows`` are the rows read, ``late`` those a closed window dropped. Every named metric
    of ``DataFrame.observe`` is added under its own name, such as ``records``, ``no_object`` and
    ``no_time`` of the landing stream. Reports come with a short delay; :meth:`settle` waits for
    those of queries that have ended.
    """

    def __init__(self) -> None:
        self._sums: dict[str, Counter] = {}
        self._ended: set[str] = set()
        self._lock = Lock()

    @classmethod
    def open(cls, spark: SparkSession) -> "Account":
        account = cls()
        spark.streams.addListener(account)
        return account

    def close(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        progress = event.progress
        found = Counter(input_rows=progress.numInputRows)
        found["late"] = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        for row in progress.observedMetrics.values():
            found.update({name: value or 0 for name, value in row.asDict().items()})
        with self._lock:
            self._sums.setdefault(progress.name or str(progress.id), Counter()).update(found)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self._lock:
            self._ended.add(str(event.runId))

    def report(self) -> dict[str, dict[str, int]]:
        """Query name -> its sums so far."""
        with self._lock:
            return {name: dict(sums) for name, sums in sorted(self._sums.items())}

    def settle(self, queries: list[StreamingQuery], seconds: float = 30) -> None:
        """Wait until the last reports of queries that have ended have come in."""
        wanted = {str(query.runId) for query in queries}
        until = time.monotonic() + seconds
        while time.monotonic() < until:
            with self._lock:
                if wanted <= self._ended:
                    return
            time.sleep(0.05)
        raise TimeoutError("no final report of all queries")
