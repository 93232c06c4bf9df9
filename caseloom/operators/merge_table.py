"""A keyed table that is merged when it is read (STA-2): entries replace those of their keys without a rewrite of the rest.

Keys lie in ``buckets`` by a hash. A put writes only the entries, as a part whose folders are buckets, and commits it with the buckets
that it touched; a read takes, bucket by bucket, the last entry of each key, and a read of given keys opens their buckets alone. Compaction
merges the parts of the buckets that have more than one and leaves the others as they lie. Deletions are entries too, until then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.commits import CommitLog


class MergeTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, *, key: str = "key", buckets: int = 64):
        self.log, self.schema, self.key, self.buckets = CommitLog(spark, path), schema, key, buckets
        self._stored = T.StructType([*schema.fields, T.StructField("_gone", T.BooleanType())])

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def put(self, entries: DataFrame, batch_id: str | None = None) -> list[int]:
        """Entries replace those of their keys; of two with one key in a put the greatest row stays. The buckets that were touched.

        A batch id makes the put idempotent. A null key is a key like any other.
        """
        return self._append(entries.select(*self.schema.names).withColumn("_gone", F.lit(False)), batch_id)

    def delete(self, keys: DataFrame, batch_id: str | None = None) -> list[int]:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(self.key) for f in self.schema.fields]
        return self._append(keys.select(*empty, F.lit(True).alias("_gone")), batch_id)

    def _append(self, rows: DataFrame, batch_id: str | None) -> list[int]:
        name = f"put-{batch_id}" if batch_id is not None else None
        if name and any(c["name"] == name for c in self.log.all()):
            return []
        one = rows.groupBy(self.key).agg(F.max(F.struct("_gone", *[c for c in self.schema.names if c != self.key])).alias("_r")).select(self.key, "_r.*").select(*self._stored.names)
        return self._write(one, name)

    def _write(self, rows: DataFrame, name: str | None, *, replaces: list[dict] | None = None) -> list[int]:
        commits = self.log.all()
        number = 1 + max((c["number"] for c in commits), default=-1)
        part = self.log.new_part(f"part-{number}")
        dealt = rows.withColumn("_bucket", self.bucket(F.col(self.key)))
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(part)
        touched = sorted(r["_bucket"] for r in self._scan(part).select("_bucket").distinct().collect()) if self._has_rows(part) else []
        content = {"number": number, "name": name, "part": part, "buckets": touched, "merged": [[c["number"], b] for c, b in replaces or ()]}
        if not self.log.commit(f"{number:012d}", content):
            self.log.drop(part)
            raise RuntimeError("another writer committed first; put again")
        return touched

    def _has_rows(self, part: str) -> bool:
        from ..session import folder_names

        return any(n.startswith("_bucket=") for n in folder_names(self.log.spark, part))

    def _scan(self, part: str) -> DataFrame:
        return self.log.spark.read.schema(T.StructType([*self._stored.fields, T.StructField("_bucket", T.IntegerType())])).parquet(part)

    def _parts(self) -> list[tuple[dict, list[int]]]:
        """Each commit with the buckets in which it still counts."""
        commits = self.log.all()
        gone = {tuple(x) for c in commits for x in c["merged"]}
        return [(c, live) for c in commits if (live := [b for b in c["buckets"] if (c["number"], b) not in gone])]

    def _entries(self, buckets: list[int] | None = None) -> DataFrame:
        """All entries with the number of their part, of some buckets or all."""
        out = None
        for c, live in self._parts():
            wanted = live if buckets is None else sorted(set(live) & set(buckets))
            if wanted:
                rows = self._scan(c["part"]).filter(F.col("_bucket").isin(wanted)).withColumn("_number", F.lit(c["number"]))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            kind = T.StructType([*self._stored.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("_number", T.IntegerType())])
            out = self.log.spark.createDataFrame([], kind)
        return out

    def _last(self, entries: DataFrame) -> DataFrame:
        row = F.struct(*self._stored.names)
        return entries.groupBy("_bucket", self.key).agg(F.max_by(row, "_number").alias("_r")).select("_r.*")

    def read(self, keys: list | None = None) -> DataFrame:
        """The table, or the rows of some keys, for which only their buckets are opened."""
        if keys is None:
            return self._last(self._entries()).filter("not _gone").select(*self.schema.names)
        asked = self.log.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]]))
        buckets = sorted({r["b"] for r in asked.select(self.bucket(F.col(self.key)).alias("b")).collect()})
        mine = self._entries(buckets).join(F.broadcast(asked.distinct().withColumnRenamed(self.key, "_asked")), F.col(self.key).eqNullSafe(F.col("_asked")), "left_semi")
        return self._last(mine).filter("not _gone").select(*self.schema.names)

    def compact(self, *, most_parts: int = 4) -> list[int]:
        """Merges the buckets that lie in more than ``most_parts`` parts into one; the buckets merged. Old parts stay until ``vacuum``, for readers under way."""
        parts = self._parts()
        several = sorted(b for b in range(self.buckets) if sum(b in live for _, live in parts) > most_parts)
        if several:
            replaced = [(c, b) for c, live in parts for b in live if b in set(several)]
            self._write(self._last(self._entries(several)).filter("not _gone"), None, replaces=replaced)
        return several

    def vacuum(self) -> int:
        """Deletes the parts that count in no bucket any more; how many."""
        live = {c["number"] for c, _ in self._parts()}
        dead = [c for c in self.log.all() if c["number"] not in live and c["buckets"] and self.log.spark is not None]
        for c in dead:
            self.log.drop(c["part"])
        return len(dead)
