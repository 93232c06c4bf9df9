"""Structured Streaming forms of extraction, task state and expiry.

Extraction and scoring are stateless projections, so a stream runs the same columns as a batch. State that a stream keeps is bounded by
its watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.extract import extract_profiles


def read_stream(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_profiles(cases: DataFrame, *, key: str = "case_id", ts: str | None = None, keep: str = "1 hour") -> DataFrame:
    """Profiles of a stream of texts; with a time column a case seen again within ``keep`` is dropped (a TTL cache)."""
    if ts:
        cases = cases.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])
    return extract_profiles(cases)


def latest_status(events: DataFrame, *, key: str = "task_id", ts: str = "ts", late: str = "5 minutes") -> DataFrame:
    """The newest status per task and window of five minutes, the time a task is kept."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, late), key).agg(F.max_by("status", ts).alias("status"), F.max(ts).alias("ts"))


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append") -> None:
    """Everything that is there now, in micro-batches, then ends; a restart goes on from the checkpoint."""
    df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
