"""Stateful operators with event-time timers: folds in order of event time, and watchers for jobs that fall silent.

Both keep their state in the state store between batches; Spark wants the RocksDB provider for them
(spark.sql.streaming.stateStore.providerClass = STORE). What the watermark has passed is final: later rows at or before it are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sooner(handle, at: int) -> None:
    """Keep one timer, the earlier of the registered one and `at`."""
    for old in list(handle.listTimers()):
        if old <= at:
            return
        handle.deleteTimer(old)
    handle.registerTimer(at)


class InOrder(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them; then they are folded in order of (time, place, value)."""

    def __init__(self, step: Callable[[str, str], str]) -> None:
        self.step = step

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, place long, value string")
        self.folded = handle.getValueState("folded", "n long, state string")

    def handleInputRows(self, key, rows, timerValues):
        new = [(r["_ms"], r["_place"], r["_value"]) for r in rows]
        self.waiting.appendList(new)
        _sooner(self.handle, min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2] is None, r[2] or ""))
        due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        n, state = self.folded.get() if self.folded.exists() else (0, "")
        for _, _, value in due:
            n, state = n + 1, self.step(state, value or "")
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        if due:
            self.folded.update((n, state))
            yield Row(_key=key[0], n=n, state=state)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, at: str, place: str, value: str, step: Callable[[str, str], str], late: str = "10 minutes") -> DataFrame:
    """(key, n, state): per-key state = step(state, value) over a stream's rows in order of event time `at` (then `place`, then value), however they
    arrive within the watermark's delay `late`. A row is given out for each key and batch that made its rows final.

    Null keys and times are left out; a null value counts as an empty one. A key holds what arrived within the delay, nothing more.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).cast("timestamp").alias("_at"), F.col(place).cast("long").alias("_place"), F.col(value).cast("string").alias("_value"))
    rows = rows.withColumn("_ms", F.unix_millis("_at")).withWatermark("_at", late)
    got = rows.groupBy("_key").transformWithState(InOrder(step), f"_key {kind}, n long, state string", "update", "eventTime")
    return got.withColumnRenamed("_key", key)


class Watch(StatefulProcessor):
    """A job's latest start, ready and load lines and its last line, all of them maxima, so that order doesn't matter; a timer runs from its last line."""

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "start long, ready long, load long, work long, last long")

    def handleInputRows(self, key, rows, timerValues):
        start, ready, load, work, last = self.seen.get() if self.seen.exists() else (-1, -1, -1, 0, -1)
        for r in rows:
            at = r["_ms"]
            last = max(last, at)
            if r["_kind"] == "start":
                start = max(start, at)
            elif r["_kind"] == "ready":
                ready = max(ready, at)
            elif r["_kind"] == "load" and (at, r["_work"]) > (load, work):
                load, work = at, r["_work"]
        self.seen.update((start, ready, load, work, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # One more: silence is over `silence`, not just as long.
        self.handle.registerTimer(last + self.silence + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        start, ready, load, work, last = self.seen.get()
        if ready >= max(start, 0) and load >= max(start, 0) and work > 0:
            yield Row(_key=key[0], last_ms=last, work=work)

    def close(self) -> None:
        pass


def silent(lines: DataFrame, job: str = "job", at: str = "ts", minutes: int = 10, late: str = "1 minute") -> DataFrame:
    """(job, last, work): a report for each time that a job which is ready and had work at its last throughput line has been silent for over
    `minutes` of event time. lines as for jobs.stale; a job that speaks again is watched anew, and is not reported if its line comes with the batch whose watermark would have
    ended the wait. Null jobs and times are left out."""
    kind = dict(lines.dtypes)[job]
    work = F.coalesce(F.col("running"), F.lit(0)) + F.coalesce(F.col("waiting"), F.lit(0))
    rows = lines.where(F.col(job).isNotNull() & F.col(at).isNotNull()).select(F.col(job).alias("_key"), F.col(at).cast("timestamp").alias("_at"), F.col("kind").alias("_kind"), work.cast("long").alias("_work"))
    rows = rows.withColumn("_ms", F.unix_millis("_at")).withWatermark("_at", late)
    got = rows.groupBy("_key").transformWithState(Watch(minutes * 60_000), f"_key {kind}, last_ms long, work long", "append", "eventTime")
    return got.select(F.col("_key").alias(job), F.timestamp_millis("last_ms").alias("last"), "work")
