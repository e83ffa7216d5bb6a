"""State with timers: deferred alerts that expire, and providers that are paced and rest (survey X1, X3, X8, S15).

Both are stateful processors keyed by what they time, on event time: a timer fires when the watermark passes it, whether or not new
rows come for its key, and what it knows survives a restart with the checkpoint. They need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators.state import KEY

DAY = 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRED = T.StructType([*(T.StructField(k, T.StringType()) for k in KEY), T.StructField("status", T.StringType()), T.StructField("at_ms", T.LongType())])
RELEASED = T.StructType([T.StructField("provider", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("url", T.StringType()), T.StructField("at_ms", T.LongType())])


def with_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Deferrals(StatefulProcessor):
    """Current status of an alert per channel and destination; a deferral that nothing ends within ``max_age_ms`` expires.

    Delivered is for good, a dry run changes nothing, and an alert that is deferred again while it is deferred keeps its first time.
    """

    def __init__(self, max_age_ms: int):
        self.max_age = max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("status", "status string, since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, since = self.now.get() if self.now.exists() else (None, None)
        was = since if status == "deferred" else None
        for r in sorted(rows, key=lambda r: (r.ms, r.seq or 0)):
            if status == "delivered" or r.status == "dry_run":
                continue
            if r.status != "deferred" or status != "deferred":
                status, since = r.status, r.ms
        if status is None:
            return
        now = since if status == "deferred" else None
        if now != was:
            if was is not None:
                self.handle.deleteTimer(was + self.max_age)
            if now is not None:
                # one that is late already expires with the next advance of the watermark
                self.handle.registerTimer(now + self.max_age)
        self.now.update((status, since))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, since = self.now.get() if self.now.exists() else (None, None)
        if status == "deferred" and since + self.max_age <= expiredTimerInfo.getExpiryTimeInMs():
            self.now.update(("expired", since + self.max_age))
            yield Row(**dict(zip(KEY, key)), status="expired", at_ms=since + self.max_age)

    def close(self) -> None:
        pass


class Pacing(StatefulProcessor):
    """Requests of a provider wait in a queue and leave it one by one, ``spacing_ms`` apart; after a 429 the provider rests."""

    def __init__(self, spacing_ms: int, rest_ms: int):
        self.spacing, self.rest = spacing_ms, rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "ms long, seq long, url string")
        self.free = handle.getValueState("free", "at long")  # when the next request may leave

    def _free(self) -> int:
        return self.free.get()[0] if self.free.exists() else 0

    def _wait(self, waiting) -> None:
        """A single timer, for the head of the queue."""
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms)
        if waiting:
            self.handle.registerTimer(max(self._free(), waiting[0][0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting = [tuple(x) for x in self.queue.get()]
        for r in rows:
            if r.kind == "request":
                waiting.append((r.ms, r.seq, r.url))
            elif r.http_status == 429:
                self.free.update((max(self._free(), r.ms + self.rest),))
        waiting.sort()
        self.queue.put(waiting) if waiting else self.queue.clear()
        self._wait(waiting)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting, now = sorted(tuple(x) for x in self.queue.get()), expiredTimerInfo.getExpiryTimeInMs()
        if waiting and max(self._free(), waiting[0][0]) <= now:
            ms, seq, url = waiting.pop(0)
            at = max(self._free(), ms)
            self.free.update((at + self.spacing,))
            self.queue.put(waiting) if waiting else self.queue.clear()
            yield Row(provider=key[0], seq=seq, url=url, at_ms=at)
        self._wait(waiting)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, event_time: str, delay: str) -> DataFrame:
    return rows.withColumn("ms", F.unix_millis(event_time)).withWatermark(event_time, delay)


def expired(events: DataFrame, max_age_days: float = 2, delay: str = "1 hour") -> DataFrame:
    """``expired`` events of a stream of delivery events (alert_key, channel, destination, status, seq, event_ts), as they fall due."""
    out = _timed(events, "event_ts", delay).groupBy(*KEY).transformWithState(Deferrals(int(max_age_days * DAY)), EXPIRED, "Append", "EventTime")
    return out.select(*KEY, "status", F.timestamp_millis("at_ms").alias("event_ts"))


def paced(rows: DataFrame, spacing_seconds: float = 5, rest_seconds: float = 60, delay: str = "0 seconds") -> DataFrame:
    """Requests of a stream as they may be sent (S15, X8): provider, seq, url and the time.

    ``rows``: provider, kind (request or response), seq, url, http_status and at.
    """
    out = _timed(rows, "at", delay).groupBy("provider").transformWithState(Pacing(int(spacing_seconds * 1000), int(rest_seconds * 1000)), RELEASED, "Append", "EventTime")
    return out.select("provider", "seq", "url", F.timestamp_millis("at_ms").alias("send_at"))
