"""The chunk index as a folder of committed batches (SNK-1, SRC-6, VEC-11)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import CommitLog


@dataclass
class Loaded:
    """What a load found: ``ok`` as the index may be used, the problems in words, and counts. ``index`` is None unless ok."""

    ok: bool
    problems: list[str] = field(default_factory=list)
    batches: int = 0
    vectors: int = 0
    documents: int = 0
    index: DataFrame | None = None


class IndexStore:
    """Chunks (doc_id, ..., embedding) of one model and dimension, appended batch by batch.

    ``append`` is idempotent by batch id, so it serves as a ``foreachBatch`` sink: ``lambda df, n: store.append(df, f"{query}-{n}")``.
    """

    def __init__(self, spark: SparkSession, path: str, *, model: str, dimension: int, vector: str = "embedding"):
        self.log, self.model, self.dimension, self.vector = CommitLog(spark, path), model, dimension, vector

    def append(self, rows: DataFrame, batch_id: str | int) -> int:
        """Writes a batch and commits it; the vectors that it added: none if the batch is there already or is empty.

        A vector that is null or of another dimension is an error, and nothing of the batch counts.
        """
        name = f"batch-{batch_id}"
        if self.log.read(name) is not None:
            return 0
        part = self.log.new_part(name)
        rows.write.parquet(part)
        found = self._counts(self.log.written(part, rows.schema))
        if found["bad"]:
            self.log.drop(part)
            raise ValueError(f"{found['bad']} of {found['n']} vectors are null or not of dimension {self.dimension}")
        if not self.log.commit(name, {"part": part, "vectors": found["n"], "model": self.model, "dimension": self.dimension, "schema": rows.schema.jsonValue()}):
            self.log.drop(part)
            return 0
        return found["n"]

    def _counts(self, rows: DataFrame) -> dict:
        bad = F.coalesce(F.size(self.vector) != self.dimension, F.lit(True)) | F.exists(self.vector, lambda x: x.isNull())
        return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("long")), F.lit(0)).alias("bad"), F.countDistinct("doc_id").alias("documents")).first().asDict()

    def load(self) -> Loaded:
        """Checks all committed batches in one pass: their counts against what was committed, model and dimension against this store's.

        Not ok, with what is wrong: no commit, no vectors, another model or dimension, a count that differs, vectors that do not fit, parts that cannot be read.
        """
        commits = [c for c in self.log.all() if "vectors" in c]
        if not commits:
            return Loaded(False, [f"no index at {self.log.path}"])
        problems = [f"batch of {c['model']}, {c['dimension']} dimensions" for c in commits if (c["model"], c["dimension"]) != (self.model, self.dimension)]
        want = sum(c["vectors"] for c in commits)
        try:
            index = self._union(commits)
            found = self._counts(index)
        except Exception as error:  # a part is gone or is no Parquet
            return Loaded(False, [*problems, f"unreadable: {str(error).splitlines()[0]}"], len(commits))
        if not want:
            problems.append("no vectors")
        if found["n"] != want:
            problems.append(f"{found['n']} vectors where {want} were committed")
        if found["bad"]:
            problems.append(f"{found['bad']} vectors are null or not of dimension {self.dimension}")
        return Loaded(not problems, problems, len(commits), found["n"], found["documents"], None if problems else index)

    def _union(self, commits: list[dict]) -> DataFrame:
        """Parts of one schema are one scan."""
        by_schema: dict[str, list[dict]] = {}
        for c in commits:
            by_schema.setdefault(str(c["schema"]), []).append(c)
        out = None
        for some in by_schema.values():
            rows = self.log.spark.read.schema(T.StructType.fromJson(some[0]["schema"])).parquet(*[c["part"] for c in some])
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out
