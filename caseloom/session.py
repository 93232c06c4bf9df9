"""The package's code on the executors, and tables that cut a lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Bytes of rows that a Python worker gets at once; Spark's own bound is 64 MB, of which a worker makes several times as much.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once per application, so that functions in it can be read there, and bounds their batches where the session does not."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, BATCH_BYTES)
    if spark.sparkContext.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        clean = shutil.copytree(package, f"{folder}/code/{os.path.basename(package)}", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='caseloom-')}/caseloom", "zip", os.path.dirname(clean)))
    _shipped.add(spark.sparkContext.applicationId)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which a cluster must name; a new one only on a single machine where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='caseloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/caseloom-{spark.sparkContext.applicationId}"
    place, fs = _folder(spark, path)
    if not fs.exists(place):
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: worked out once, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(table: DataFrame) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    place, fs = _folder(table.sparkSession, table.stored_at)
    fs.delete(place, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system; none where there is no such folder."""
    place, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
