"""Cache lookups as a stream with state for groups of keys: what operators/cacheops.cache_lookup() says of a table.

Events wait in their group's state until the watermark has passed them, and are then taken in order of time (of one instant
entries first, by id). So a request meets the latest entry before it, whichever of the two arrives first, as long
as neither is later than `late`; Spark drops what is. One timer, at the first instant that something waits for, wakes the group when
its time has come, in a batch without data too, and all that is due is taken at once: calls go by group and batch, not by key or
event. Of a key's entries only the last one taken is kept. With `forget_s`, an event of its own removes it that
long after its time to live is over; requests that come later are misses then, not expired ones. Without it a key is kept for
good. A task holds what waits in one group at a time. The session's state store has to be RocksDB (rocks()).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups of keys. Keep it as long as a stream lives; choose it so that what waits in a group fits a task.
GROUPS = 1024
OUT = "request_id long, cache_key string, status string, age_s double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Lookups(StatefulProcessor):
    """`last`: (set at, time to live) of each key's last entry. `waiting`: events whose time hasn't come. `wake`: the time of the timer
    that wakes the group. Times are microseconds."""

    ENTRY, REQUEST, FORGET = 0, 1, 2

    def __init__(self, forget_s: float | None):
        self.forget_s = forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "cache_key string", "at long, ttl_s double")
        self.waiting = handle.getListState("waiting", "cache_key string, at long, kind int, id long, ttl_s double")
        self.wake = handle.getValueState("wake", "at long")

    def _wake_at(self, at: int) -> None:
        self.wake.update((at,))
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = list(zip(*(part[c].tolist() for c in ("cache_key", "at", "kind", "id", "ttl_s")), strict=True))
            if new:
                self.waiting.appendList(new)
                first = min(x[1] for x in new) if first is None else min(first, *(x[1] for x in new))
        # a timer that is registered later than this one stays, and finds nothing to do or what is due then
        if first is not None and (not self.wake.exists() or first < self.wake.get()[0]):
            self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.wake.exists() or self.wake.get()[0] > now:
            return
        due, rest, out = [], [], []
        for x in self.waiting.get():
            (due if x[1] <= now else rest).append(tuple(x))
        due.sort()
        for name, events in groupby(due, key=lambda x: x[0]):
            found = self.last.getValue((name,))
            before = last = None if found is None else tuple(found)
            for _, at, kind, i, ttl in events:
                if kind == self.ENTRY:
                    last = (at, ttl)
                elif kind == self.REQUEST:
                    last = self._kept(last, at)
                    age = None if last is None else (at - last[0]) / 1e6
                    out.append((i, name or None, "miss" if last is None else "hit" if age <= last[1] else "expired", age))
            last = self._kept(last, now)
            if last is None:
                if before is not None:
                    self.last.removeKey((name,))
            elif last != before:
                self.last.updateValue((name,), last)
                if self.forget_s is not None:
                    rest.append((name, self._end(last) + 1, self.FORGET, 0, 0.0))
        self.waiting.put(rest) if rest else self.waiting.clear()
        self._wake_at(min(x[1] for x in rest)) if rest else self.wake.clear()
        if out:
            yield pd.DataFrame(out, columns=["request_id", "cache_key", "status", "age_s"]).astype({"age_s": "float64"})

    def _end(self, last: tuple[int, float]) -> int:
        return last[0] + int((last[1] + self.forget_s) * 1e6)

    def _kept(self, last: tuple[int, float] | None, at: int) -> tuple[int, float] | None:
        """The entry, or none if it is forgotten by then."""
        return None if last is None or self.forget_s is not None and self._end(last) < at else last

    def close(self) -> None:
        pass


def cache_lookup_stream(events: DataFrame, late: str = "10 minutes", forget_s: float | None = None, groups: int = GROUPS) -> DataFrame:
    """(request_id, cache_key, status, age_s) of a stream of events (key, ts, id, ttl_s): entries have a ttl_s, requests none."""
    at = F.col("ts").cast("timestamp")
    kind = F.when(F.col("ttl_s").isNull(), Lookups.REQUEST).otherwise(Lookups.ENTRY)
    number = lambda c, to: F.coalesce(c.cast(to), F.lit(0).cast(to))
    # a null key is an empty name inside
    rows = events.select(F.coalesce(F.md5("key"), F.lit("")).alias("cache_key"), at.alias("ts"), number(F.unix_micros(at), "long").alias("at"), kind.alias("kind"), number(F.col("id"), "long").alias("id"), number(F.col("ttl_s"), "double").alias("ttl_s"))
    own = rows.withColumn("part", F.pmod(F.xxhash64("cache_key"), F.lit(groups)).cast("int")).withWatermark("ts", late).groupBy("part")
    return own.transformWithStateInPandas(Lookups(forget_s), OUT, "Append", "EventTime")
