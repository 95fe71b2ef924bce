"""Work that repeats: cleaning of expired records, limits, and handles that stop."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewater.catalog import Collection
from tidewater.operators import memory


class Repeating:
    """Calls ``work`` every ``seconds`` until it is stopped; what it raises ends it and is kept in ``error``."""

    def __init__(self, work: Callable[[], object], seconds: float):
        self.work, self.seconds, self.error = work, seconds, None
        self._end = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        while not self._end.wait(self.seconds):
            try:
                self.work()
            except Exception as e:
                self.error = e
                return

    @property
    def running(self) -> bool:
        return self._thread.is_alive()

    def stop(self) -> None:
        """Let the current call end and make no other."""
        self._end.set()
        self._thread.join()


def start_cleaner(collection: Collection, seconds: float, clock: Callable[[], datetime], done: Callable[[int], object] | None = None) -> Repeating:
    """Delete expired records again and again; ``done`` hears how many went, if any did."""

    def clean() -> None:
        n = collection.cleanup_expired(clock())
        if n and done is not None:
            done(n)

    return Repeating(clean, seconds)


def start_limiter(collection: Collection, max_records: int, policy: str, seconds: float, batch: int | None = None) -> Repeating:
    """Hold a collection to a number of records, by :func:`tidewater.operators.memory.enforce_limit`."""

    def enforce() -> None:
        left = memory.enforce_limit(collection.records, max_records, policy, batch)
        collection._set(left, "evict")

    return Repeating(enforce, seconds)


def subscribe(events: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each batch of match events to ``call``; ``stop()`` of the returned query unsubscribes."""
    return events.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).start()
