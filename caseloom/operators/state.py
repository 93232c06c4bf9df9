"""Cache and task state (STA-1 to STA-8) as tables: a log of entries, the newest per key, and expiry by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TASK_STATES = ("pending", "processing", "completed", "failed")
#: How long a task is kept after it was made.
KEPT_SECONDS = 300


def next_states(status: str | None) -> tuple[str, ...]:
    """What a task in this state may become; None: it is not there yet."""
    return {None: TASK_STATES[:1], TASK_STATES[0]: TASK_STATES[1:2], TASK_STATES[1]: TASK_STATES[2:]}.get(status, ())


def _age(now: Column, ts: str) -> Column:
    """Seconds from ts, with or without a time zone, to now."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6


def latest(log: DataFrame, key: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """STA-5: the newest row of each key. An aggregation, so a hot key is combined before it moves."""
    rank = F.struct(ts, tie) if tie else F.struct(ts)
    row = F.struct(*log.columns)
    return log.groupBy(key).agg(F.max_by(row, rank).alias("_r")).select("_r.*")


def live(cache: DataFrame, now: Column, ttl_seconds: float = 3600, ts: str = "ts") -> DataFrame:
    """STA-1: entries that are not older than the time to live."""
    return cache.filter(_age(now, ts) <= ttl_seconds)


def put(cache: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """STA-2: entries replace those of their keys."""
    return cache.join(entries.select(key).distinct(), key, "left_anti").unionByName(entries)


def delete(cache: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return cache.join(keys.select(key).distinct(), key, "left_anti")


def cache_key(*parts: Column) -> Column:
    """STA-3: one key from the parameters; NULL as None."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def task_id(*parts: Column) -> Column:
    """Twelve hex digits, the same for the same request."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 12)


def expired(tasks: DataFrame, now: Column, seconds: float = 300, ts: str = "ts") -> DataFrame:
    """STA-6."""
    return tasks.filter(_age(now, ts) > seconds)


def error_detail(detail: Column, message: Column, error: Column, status_text: Column) -> Column:
    """STA-8: the first that says something."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (detail, message, error)], status_text)


def running_states(log: DataFrame, key: str = "task_id", ts: str = "ts") -> DataFrame:
    """STA-5, the whole course: each change of a task with its time in the state before."""
    course = Window.partitionBy(key).orderBy(ts)
    return log.withColumn("previous", F.lag("status").over(course)).withColumn("_was", F.lag(ts).over(course)).withColumn("waited", _age(F.col(ts), "_was")).drop("_was")


def expiries(puts: DataFrame, until: Column, ttl_seconds: float = 3600, key: str = "key", ts: str = "ts") -> DataFrame:
    """STA-1, STA-6: the puts that no later put of their key renewed within the time to live, with expired_at, as far as that lies before ``until``."""
    at = F.col(ts).cast("timestamp")
    ends = F.timestamp_micros(F.unix_micros(at) + F.lit(int(ttl_seconds * 1_000_000)))
    following = F.lead(at).over(Window.partitionBy(key).orderBy(ts))
    return puts.withColumn("_next", following).withColumn("expired_at", ends).filter((F.col("_next") > F.col("expired_at")) | (F.col("_next").isNull() & (F.col("expired_at") < until))).drop("_next")


def admitted(log: DataFrame, key: str = "task_id", ts: str = "ts", tie: str = "tie") -> DataFrame:
    """STA-5 over a whole log (key, status, ts, tie) of tasks that are kept: each change with accepted, by the course pending, processing, completed or failed.

    A change is admitted if it is the first of its stage after the one admitted before. So three aggregations tell them all, each combined
    before it moves; no task's changes are collected. Of one time the least tie comes first, which is unique for a task and time.
    """
    at = F.struct(ts, tie)
    step = lambda rows, names, after: rows.filter(F.col("status").isin(*names) & after).groupBy(key).agg(F.min(at).alias("_at"))
    made = step(log, TASK_STATES[:1], F.lit(True))
    begun = step(log.join(made.withColumnRenamed("_at", "_after"), key), TASK_STATES[1:2], at > F.col("_after"))
    ended = step(log.join(begun.withColumnRenamed("_at", "_after"), key), TASK_STATES[2:], at > F.col("_after"))
    points = made.select(key, F.col("_at").alias("_a")).join(begun.select(key, F.col("_at").alias("_b")), key, "left").join(ended.select(key, F.col("_at").alias("_c")), key, "left")
    of_stage = F.when(F.col("status") == TASK_STATES[0], F.col("_a")).when(F.col("status") == TASK_STATES[1], F.col("_b")).otherwise(F.col("_c"))
    return log.join(points, key, "left").withColumn("accepted", F.coalesce(at == of_stage, F.lit(False))).drop("_a", "_b", "_c")
