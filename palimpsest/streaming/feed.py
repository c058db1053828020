"""Live activity feeds on Structured Streaming: publish, subscribe, and wait until an assertion holds."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.operators import feed as batch

DEFAULT_TIMEOUT, TIMEOUT_VARIABLE = 5.0, "PALIMPSEST_WAIT_TIMEOUT"


class WaitTimeoutError(TimeoutError):
    """The assertion has not held in time. Its last failure is the cause."""

    def __init__(self, elapsed: float, entity: str | None, last: BaseException | None):
        about = f" for entity '{entity}'" if entity is not None else ""
        super().__init__(f"Timed out waiting for the assertion{about} after {elapsed:.1f} s." + (f" Last failure: {last}" if last else ""))
        self.elapsed, self.entity, self.last_failure = elapsed, entity, last


class Cancelled(Exception):
    """The wait was cancelled."""


class DisposedError(RuntimeError):
    """The feed has been closed."""


class ManualClock:
    """A clock that only moves when told to; event time comes from it, never from the machine."""

    def __init__(self, start: datetime = datetime(2026, 1, 1, tzinfo=timezone.utc)):
        self._now, self._lock = start, threading.Lock()

    def now(self) -> datetime:
        return self._now

    def advance(self, by: timedelta) -> datetime:
        if by < timedelta(0):
            raise ValueError("a clock can't go back")
        with self._lock:
            self._now += by
            return self._now


def default_timeout() -> float:
    return float(os.environ.get(TIMEOUT_VARIABLE, DEFAULT_TIMEOUT))


class ActivityFeed:
    """An append-only table of events and its subscribers. Each subscriber is a streaming query with its own progress."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, clock: Callable[[], datetime] | None = None):
        self.spark, self.path, self.clock = spark, path, clock
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._queries: list[StreamingQuery] = []
        self._closed = False
        spark.createDataFrame([], self.schema).write.mode("append").parquet(path)

    def _open(self) -> None:
        if self._closed:
            raise DisposedError("the feed is closed")

    def publish(self, events: DataFrame) -> None:
        """Append events; nothing happens once the feed is closed."""
        if self._closed:
            return
        if self.clock is not None and "ts" in self.schema.names:
            events = events.withColumn("ts", F.lit(self.clock()).cast(self.schema["ts"].dataType))
        events.select(*self.schema.names).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        self._open()
        return self.spark.read.schema(self.schema).parquet(self.path)

    def last(self) -> int:
        return self.table().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def stream(self, replay: bool = False, where: Column | None = None) -> DataFrame:
        """Streaming rows from now on and, with ``replay``, from the start of the history."""
        self._open()
        now = self.last()
        first = now if not replay else (batch.history(self.table(), now).agg(F.min("seq")).first()[0] or 1) - 1
        rows = self.spark.readStream.schema(self.schema).parquet(self.path).where(F.col("seq") > first)
        return rows if where is None else rows.where(where)

    def subscribe(self, each: Callable[[DataFrame, int], None], replay: bool = False, where: Column | None = None, checkpoint: str | None = None) -> StreamingQuery:
        """Call ``each`` for every batch of new events."""
        writer = self.stream(replay, where).writeStream.foreachBatch(each)
        query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
        self._queries.append(query)
        return query

    def wait_for(self, assertion: Callable[[], Any], entity: str | None = None, where: Column | None = None, timeout: float | None = None, cancelled: threading.Event | None = None, poll: float = 0.05) -> Any:
        """Try once, then again after every matching event, until the assertion stops raising; return what it returns.

        The subscription starts before the first try, so no event between the two is lost. Time runs from the first try on.
        """
        self._open()
        if cancelled is not None and cancelled.is_set():
            raise Cancelled
        limit = default_timeout() if timeout is None else timeout
        match = where if entity is None else (F.col("entity_id") == entity) & (F.lit(True) if where is None else where)
        pending: list[int] = []
        lock = threading.Lock()

        def count(rows: DataFrame, _: int) -> None:
            n = rows.count()
            with lock:
                pending.append(n)

        query = self.subscribe(count, where=match)
        last: BaseException | None = None
        try:
            try:
                return assertion()
            except Exception as e:
                last = e
            began = time.monotonic()
            while (spent := time.monotonic() - began) < limit:
                if cancelled is not None and cancelled.is_set():
                    raise Cancelled
                if self._closed:
                    raise DisposedError("the feed was closed during the wait") from last
                with lock:
                    events = sum(pending)
                    pending.clear()
                for _ in range(events):
                    try:
                        return assertion()
                    except Exception as e:
                        last = e
                if not events:
                    time.sleep(poll)
            raise WaitTimeoutError(spent, entity, last) from last
        finally:
            query.stop()

    def close(self) -> None:
        """End all subscriptions. Later use is an error, publishing excepted."""
        self._closed = True
        for q in self._queries:
            if q.isActive:
                q.stop()


def take_per_entity_stream(rows: DataFrame, count: int) -> DataFrame:
    """The first ``count`` events of each entity of a stream: how many have passed is the state of an entity."""

    def step(key, batches, state):
        seen = state.get[0] if state.exists else 0
        for part in batches:
            keep = part.sort_values("seq").head(max(0, count - seen))
            seen += len(keep)
            if len(keep):
                yield keep
        state.update((seen,))

    return rows.groupBy("entity_id").applyInPandasWithState(step, rows.schema, "n long", "append", "NoTimeout")
