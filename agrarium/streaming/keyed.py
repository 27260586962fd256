"""Keyed state by transformWithState: a rate limiter and a cache whose entries expire.

State lives in RocksDB with the executors and ends by timers: a limiter's key
is gone one window after its last request, a cache's entry once the watermark
has passed its expiry. Times are those of the events. Within a batch a key's
rows are put in order of time; rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which these processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _ordered(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r["t"], r["id"]))


class _Sliding(StatefulProcessor):
    """Allows a request if fewer than ``most`` allowed ones lie within the ``seconds`` before it."""

    def __init__(self, most: int, seconds: float, key: str) -> None:
        self.most, self.seconds, self.key = most, seconds, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "t double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before, out = [t for (t,) in self.hits.get()], []
        hits = before
        for row in _ordered(rows):
            hits = [h for h in hits if h > row["t"] - self.seconds]
            allowed = len(hits) < self.most
            if allowed:
                hits.append(row["t"])
            out.append(Row(**{self.key: key[0], "id": row["id"], "allowed": allowed}))
        if hits != before:
            self.hits.put([(h,) for h in hits]) if hits else self.hits.clear()
        # The last hit's timer stands if it was there before.
        if hits and (not before or max(hits) > max(before)):
            self.handle.registerTimer(int((max(hits) + self.seconds) * 1000) + 1)
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        over = expiredTimerInfo.getExpiryTimeInMs() / 1000 - self.seconds
        hits = [(t,) for (t,) in self.hits.get() if t > over]
        self.hits.put(hits) if hits else self.hits.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Fixed(StatefulProcessor):
    """Allows the first ``most`` requests of each window of ``seconds`` on the clock."""

    def __init__(self, most: int, seconds: float, key: str) -> None:
        self.most, self.seconds, self.key = most, seconds, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "w long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        counts, out = dict(self.counts.get()), []
        last = max(counts, default=None)
        for row in _ordered(rows):
            w = int(row["t"] // self.seconds)
            counts[w] = counts.get(w, 0) + 1
            out.append(Row(**{self.key: key[0], "id": row["id"], "allowed": counts[w] <= self.most}))
        # Windows that the watermark has passed get no more requests after this batch.
        over = int(timerValues.getCurrentWatermarkInMs() / 1000 // self.seconds)
        open_ = [(w, n) for w, n in counts.items() if w >= over]
        self.counts.put(open_) if open_ else self.counts.clear()
        # One timer, when the last window is over, ends the state.
        if max(counts) != last:
            self.handle.registerTimer(int((max(counts) + 1) * self.seconds * 1000))
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        over = int(expiredTimerInfo.getExpiryTimeInMs() / 1000 // self.seconds)
        counts = [(w, n) for w, n in self.counts.get() if w >= over]
        self.counts.put(counts) if counts else self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str, at: str, identity: str, most: int, seconds: float, sliding: bool = True, late: str = "10 minutes") -> DataFrame:
    """(key, id, allowed) for each request of a stream of (key, at, identity).

    ``sliding``: fewer than ``most`` allowed requests within the ``seconds``
    before; else the first ``most`` of each window on the clock. Requests of one
    instant go by identity.
    """
    kinds = dict(events.dtypes)
    timed = events.select(key, F.col(identity).alias("id"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    timed = timed.withColumn("t", F.unix_micros("at") / F.lit(1e6))
    processor = (_Sliding if sliding else _Fixed)(most, seconds, key)
    return timed.groupBy(key).transformWithState(processor, f"{key} {kinds[key]}, id {kinds[identity]}, allowed boolean", "append", "EventTime")


class _Cache(StatefulProcessor):
    """Entries of a namespace: a map from key to value and expiry."""

    def __init__(self, space: str) -> None:
        self.space = space

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value string, expires double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        # Entries are read once and written once a batch, whatever is done to them in between.
        out, before, now = [], {}, {}

        def held(name: str) -> tuple[str, float] | None:
            if name not in now:
                found = self.entries.getValue((name,))
                before[name] = now[name] = (found[0], found[1]) if found is not None else None
            return now[name]

        for row in _ordered(rows):
            name, op = row["key"], row["op"]
            if op == "set":
                held(name)
                now[name] = (row["value"], row["t"] + row["ttl"] if row["ttl"] and row["ttl"] > 0 else float("inf"))
            elif op == "get":
                found = held(name)
                out.append(Row(**{self.space: key[0], "id": row["id"], "key": name, "value": found[0] if found and row["t"] <= found[1] else None}))
            elif op == "delete":
                held(name)
                now[name] = None
            elif op == "prefix":
                for (k,) in list(self.entries.keys()):
                    if k.startswith(name):
                        held(k)
                now.update({k: None for k in now if k.startswith(name)})
        for name, entry in now.items():
            if entry != before[name]:
                self.entries.updateValue((name,), entry) if entry else self.entries.removeKey((name,))
        # The first of the new entries to expire has a timer, which gives the next one its own.
        self._wait(e for n, e in now.items() if e and e != before[n])
        return iter(out)

    def _wait(self, entries: Iterable[tuple[str, float]]) -> None:
        first = min((expires for _, expires in entries), default=float("inf"))
        if first < float("inf"):
            self.handle.registerTimer(int(first * 1000) + 1)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000
        entries = {k: (value, expires) for (k,), (value, expires) in self.entries.iterator()}
        gone = [k for k, (_, expires) in entries.items() if expires < now]
        for k in gone:
            self.entries.removeKey((k,))
        self._wait(e for k, e in entries.items() if k not in gone)
        return iter(())

    def close(self) -> None:
        pass


def cached(operations: DataFrame, space: str, late: str = "10 minutes") -> DataFrame:
    """(space, id, key, value) for each "get" of a stream of (space, id, at, op, key, value, ttl).

    Operations are set (``ttl`` in seconds; null, zero or less never expires),
    get, delete, and prefix, which deletes all keys of the space that begin with
    ``key``. A value is null if there is none or it has expired. Entries that
    have expired are deleted as the watermark passes. A space is one group of
    state: keys that a prefix can delete together lie together.
    """
    kinds = dict(operations.dtypes)
    timed = operations.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).withColumn("t", F.unix_micros("at") / F.lit(1e6))
    timed = timed.select(space, "id", "at", "t", "op", "key", "value", F.col("ttl").cast("double").alias("ttl"))
    return timed.groupBy(space).transformWithState(_Cache(space), f"{space} {kinds[space]}, id {kinds['id']}, key string, value string", "append", "EventTime")


def steps(rows: DataFrame, at: str, ends: list[str]) -> list[DataFrame]:
    """The table in steps of time, each up to one of ``ends`` and the last without one."""
    kind, out = dict(rows.dtypes)[at], []
    for lo, hi in zip([None, *ends], [*ends, None], strict=True):
        part = rows if lo is None else rows.where(F.col(at) >= F.lit(lo).cast(kind))
        out.append(part if hi is None else part.where(F.col(at) < F.lit(hi).cast(kind)))
    return out


def run_in_steps(spark: SparkSession, rows: DataFrame, at: str, ends: list[str], build: Any, root: str) -> DataFrame:
    """What a stream makes of a table that arrives in steps of time, the query being stopped and started again between them."""
    out = f"{root}/out"
    with rocksdb(spark):
        for part in steps(rows, at, ends):
            part.write.mode("append").parquet(f"{root}/in")
            found = build(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
            found.writeStream.option("checkpointLocation", f"{root}/state").format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
