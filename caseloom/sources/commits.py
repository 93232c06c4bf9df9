"""A folder of immutable parts with a log of commits: what appends and compactions share.

A part is written under ``data/`` and counts only from its commit on, a small file under ``commits/`` whose creation fails if it is there
already. So a batch that is written twice (a task tried again, a restarted stream) counts once, and readers never see half a batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import _folder, folder_names


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def names(self) -> list[str]:
        """Of all commits, in order; unfinished ones (an empty file after a crash) are left out by ``read``."""
        return [n.removesuffix(".json") for n in folder_names(self.spark, f"{self.path}/commits") if n.endswith(".json")]

    def read(self, name: str) -> dict | None:
        place, fs = _folder(self.spark, f"{self.path}/commits/{name}.json")
        if not fs.exists(place):
            return None
        source = fs.open(place)
        try:
            raw = bytes(source.readAllBytes())
        finally:
            source.close()
        return json.loads(raw) if raw else None

    def all(self) -> list[dict]:
        return [c for n in self.names() if (c := self.read(n)) is not None]

    def commit(self, name: str, content: dict) -> bool:
        """False if that commit is there already. The file appears whole: it is written beside and renamed, which fails where the name is taken."""
        place, fs = _folder(self.spark, f"{self.path}/commits/{name}.json")
        if fs.exists(place):
            return False
        beside, _ = _folder(self.spark, f"{self.path}/commits/.{name}-{uuid.uuid4().hex[:8]}")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.rename(beside, place):
            return True
        fs.delete(beside, False)
        return False

    def new_part(self, name: str) -> str:
        """A place for data that nothing reads before its commit."""
        return f"{self.path}/data/{name}-{uuid.uuid4().hex[:8]}"

    def drop(self, part: str) -> None:
        place, fs = _folder(self.spark, part)
        fs.delete(place, True)

    def drop_commit(self, name: str) -> None:
        self.drop(f"{self.path}/commits/{name}.json")

    def written(self, part: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(part)
