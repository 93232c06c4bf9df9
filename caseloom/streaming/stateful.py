"""Keyed state of streams (STA-1, STA-5, STA-6): a cache whose entries expire, and tasks that admit only their course.

Both keep one small value for a key, emit from event-time timers, and give what ``operators.state`` gives for the same log as a table. The
state store is RocksDB (``with_state`` sets it), so state beyond memory lies on disk; a key's rows of a batch are taken in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.state import KEPT_SECONDS, next_states

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRY = "key string, value string, ts timestamp, expired_at timestamp"
CHANGE = "task_id string, ts timestamp, status string, previous string, accepted boolean, reason string"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros * 1000)


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    frames = [f for f in rows if len(f)]
    return pd.concat(frames).sort_values(list(by), kind="stable") if frames else pd.DataFrame()


class _Cache(StatefulProcessor):
    """The entry of a key, until no put has come for the time to live."""

    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, ts long")

    def _gone(self, key: str, value: str, ts: int) -> tuple:
        return key, value, _time(ts), _time(ts + self.ttl)

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(rows, columns=["key", "value", "ts", "expired_at"]).astype({"ts": "datetime64[ns]", "expired_at": "datetime64[ns]"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.entry.get(), []
        for value, ts in _in_order(rows, "ts")[["value", "ts"]].itertuples(index=False):
            now = _micros(ts)
            if held is not None and now < held[1]:
                continue  # older than what is held
            if held is not None and now - held[1] > self.ttl:
                out.append(self._gone(key[0], *held))
            held = (value, now)
        self.entry.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((held[1] + self.ttl) // 1000 + 1)
        yield from self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get()
        self.entry.clear()
        yield from self._out([self._gone(key[0], *held)] if held is not None else [])


def expiries(puts: DataFrame, *, ttl_seconds: float = 3600, late: str = "0 seconds") -> DataFrame:
    """STA-1, STA-6: of a stream of puts (key, value, ts) the entries that no put renewed within the time to live, when the watermark has passed that time.

    Puts of a key come in order of time, within ``late``; one older than what is held is passed over.
    """
    with_state(puts.sparkSession)
    rows = puts.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Cache(ttl_seconds), EXPIRY, "append", "eventTime")


class _Task(StatefulProcessor):
    """Where a task stands; forgotten ``kept`` seconds after it was made, so that its id can be used again."""

    def __init__(self, kept: float):
        self.kept = int(kept * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "status string, made long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found, out = self.task.get(), []
        status, made = found if found is not None else (None, None)
        for asked, ts in _in_order(rows, "ts", "tie")[["status", "ts"]].itertuples(index=False):
            now = _micros(ts)
            if made is not None and now - made > self.kept:
                status, made = None, None
            accepted = asked in next_states(status)
            reason = None if accepted else f"{status or 'none'} does not become {asked}"
            out.append((key[0], ts, asked, status, accepted, reason))
            if accepted:
                made = now if status is None else made
                status = asked
        if status is not None:
            self.task.update((status, made))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((made + self.kept) // 1000 + 1)
        elif found is not None:
            self.task.clear()
        yield pd.DataFrame(out, columns=["task_id", "ts", "status", "previous", "accepted", "reason"]).astype({"ts": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.task.clear()
        yield pd.DataFrame([], columns=["task_id", "ts", "status", "previous", "accepted", "reason"]).astype({"ts": "datetime64[ns]", "accepted": bool})


def task_changes(log: DataFrame, *, kept_seconds: float = KEPT_SECONDS, late: str = "0 seconds") -> DataFrame:
    """STA-5: of a stream of asked changes (task_id, status, ts[, tie]) each with the state before, and whether it was admitted or why not.

    A task is made as pending, becomes processing, then completed or failed; it is forgotten ``kept_seconds`` after it was made. Changes of one time
    are taken by tie. Within ``late`` a task's changes come in order of time.
    """
    with_state(log.sparkSession)
    tie = F.col("tie").cast("long") if "tie" in log.columns else F.lit(0).cast("long")
    rows = log.select(F.col("task_id").cast("string").alias("task_id"), F.col("status").cast("string").alias("status"), "ts", tie.alias("tie")).withWatermark("ts", late)
    return rows.groupBy("task_id").transformWithStateInPandas(_Task(kept_seconds), CHANGE, "append", "eventTime")
