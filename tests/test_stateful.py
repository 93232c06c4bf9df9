"""Streams with keyed state against the same log as a table."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import state
from caseloom.streaming import stateful, stream


def _replayed(spark, folder, rows, schema, files):
    """A stream of rows, in as many batches as files; rows are in order of time."""
    size = -(-len(rows) // files)
    for i in range(files):
        df = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).withColumn("ts", F.timestamp_micros("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return stream.read_stream(spark, f"{folder}/in", df.schema, files_per_trigger=1), spark.read.parquet(f"{folder}/in")


def _all(df, folder):
    out: list = []
    stream.run_available(df, lambda rows, _: out.extend(rows.collect()), f"{folder}/checkpoint")
    return out


def test_expiries_of_a_stream_equal_those_of_the_log(spark, tmp_path):
    rng, now, rows = random.Random(6), 1_700_000_000_000_000, []
    for i in range(240):
        now += rng.randrange(1, 40_000_000)
        rows.append((rng.choice("abcdef"), f"v{i}", now))
    flowing, log = _replayed(spark, str(tmp_path), rows, "key string, value string, ts long", 6)
    got = sorted((r["key"], r["value"], r["expired_at"]) for r in _all(stateful.expiries(flowing, ttl_seconds=90), str(tmp_path)))
    want = sorted((r["key"], r["value"], r["expired_at"]) for r in state.expiries(log, F.timestamp_micros(F.lit(now)), 90).collect())
    assert got == want and 20 < len(want) < 240


def test_changes_of_tasks_in_a_stream_equal_those_of_the_log(spark, tmp_path):
    rng, now, rows = random.Random(7), 1_700_000_000_000_000, []
    for i in range(200):
        now += rng.randrange(0, 2) * 1_000_000
        rows.append((f"t{rng.randrange(20)}", rng.choice([*state.TASK_STATES, "odd"]), now, i))
    flowing, log = _replayed(spark, str(tmp_path), rows, "task_id string, status string, ts long, tie long", 5)
    found = _all(stateful.task_changes(flowing, kept_seconds=10**6), str(tmp_path))
    got = sorted((r["task_id"], r["ts"], r["status"], r["accepted"]) for r in found)
    assert got == sorted((r["task_id"], r["ts"], r["status"], r["accepted"]) for r in state.admitted(log).collect())
    assert all(r["accepted"] == (r["reason"] is None) for r in found) and "none does not become completed" in {r["reason"] for r in found}


@pytest.mark.parametrize("files", [1, 6])
def test_a_task_is_forgotten_after_its_time(spark, tmp_path, files):
    at = lambda s: 1_700_000_000_000_000 + s * 1_000_000
    rows = [("a", "pending", at(0), 0), ("a", "processing", at(299), 1), ("a", "completed", at(301), 2), ("a", "pending", at(302), 3), ("b", "pending", at(900), 4), ("a", "pending", at(901), 5)]
    flowing, _ = _replayed(spark, str(tmp_path), rows, "task_id string, status string, ts long, tie long", files)
    found = {(r["task_id"], (r["ts"].timestamp() - 1_700_000_000)): (r["accepted"], r["previous"]) for r in _all(stateful.task_changes(flowing), str(tmp_path))}
    assert found == {("a", 0): (True, None), ("a", 299): (True, "pending"), ("a", 301): (False, None), ("a", 302): (True, None), ("b", 900): (True, None), ("a", 901): (True, None)}
