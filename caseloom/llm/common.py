"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; a folder of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="caseloom-")
        spark.conf.set("spark.checkpoint.dir", f"file://{root}")
        root = f"file://{root}"
    path = f"{root}/caseloom-{spark.sparkContext.applicationId}"
    place, fs = _folder(spark, path)
    if not fs.exists(place):
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared scratch folder: the lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(df: DataFrame) -> None:
    """Deletes a table that saved() wrote and that nothing reads any more."""
    removed_folder(df.sparkSession, df.saved_path)


def removed_folder(spark: SparkSession, path: str) -> None:
    place, fs = _folder(spark, path)
    fs.delete(place, True)


def files_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    place, fs = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


_held: dict = {}


def held(kind: str, key: object, make: Callable[[], object]):
    """What a worker keeps between its tasks: one thing at a time, so that operators that follow each other in a worker don't add up."""
    if (kind, key) not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[kind, key] = make()
    return _held[kind, key]


def released() -> None:
    """Drops what a worker keeps for another operator; for tasks that need the memory."""
    _held.clear()


#: log2 of the bits of a table of ids.
ID_BITS = 24


def _id_bits(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def among(spark: SparkSession, ids: DataFrame, key: str, many: int = 64) -> Column:
    """False for most values of key that are not in ids (whole numbers), true for all that are: by a table of 2 MB whatever their number; null gives false."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << ID_BITS, bool)
        for batch in batches:
            bits[_id_bits(batch.column(0).drop_null().to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    table = np.zeros(1 << ID_BITS >> 3, np.uint8)
    for r in ids.select(F.col(key).cast("long")).coalesce(many).mapInArrow(marked, "bits binary").toLocalIterator():
        table |= np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            yield pa.array(bits[_id_bits(batch.fill_null(0).to_numpy(zero_copy_only=False))] & batch.is_valid().to_numpy(zero_copy_only=False))

    return found(F.col(key).cast("long"))


def whole(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
