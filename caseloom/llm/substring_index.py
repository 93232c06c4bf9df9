"""Substring deduplication with a log-structured index of window fingerprints.

Every window of ``window`` (35) words is represented by its minimiser: of the hashes of its 8-word grams the least, leftmost
first. Equal windows have equal minimisers, and neighbouring windows mostly share one, so about one position in 14 is kept: an
anchor. The index is a folder of immutable runs (print, n) of the anchors' fingerprints, each a table bucketed and sorted by
print. A batch becomes one run, which is merge-joined with each run of history, without exchange or sort, to find what repeats;
two runs of one level are then compacted by merging, so there are about log(batches) of them. An index that lasts has runs of a second
kind beside these: the distinct windows of each call, as (print, 128-bit hash), bucketed, sorted and compacted in the same way. What a later call's
prints meet in history is verified against them by one more merge join, so no text of an earlier call is kept or read again, and history is
neither exchanged nor sorted but when it is compacted. A manifest tells which runs count; by it the index is opened again later (``FingerprintIndex``).

A fingerprint that occurs once rules its windows out. The windows of the others, in this call's texts and in the window runs of
history, are verified by a 128-bit hash of the bytes of their words: those of this call that occur once are let go, all
words in the rest are removed. Hashes are counted with map-side combination, so one passage in any share
of the documents is a few rows per task.

Words are runs of anything but ASCII white space, unchanged. Defined results: null text -> no words, nothing removed. Texts of
fewer words than a window are never touched. Repeated rows are documents of their own, so their windows repeat. Rows with
null ids are dealt with like others. An empty table -> no rows. Extra columns are ignored. A call that ends before its
manifest is written leaves the index as it was.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import dropped, files_in, removed_folder, saved, scratch_root
from .hashing import Windows, word_hashes

GRAM = 8
#: Runs of one level that are merged into one of the next.
FANOUT = 2
_grams = Windows(0x9E3779B97F4A7C15)


def leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` values the place of the least, the leftmost of equals: by doubling the width of stretches."""
    least, at, width = values, np.arange(len(values)), 1

    def joined(shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = least[shift:] < least[:-shift]
        return np.where(right, least[shift:], least[:-shift]), np.where(right, at[shift:], at[:-shift])

    while 2 * width <= span:
        least, at = joined(width)
        width *= 2
    return joined(span - width)[1] if span > width else at


def minimisers(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its minimiser, and the hashes of all grams."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _grams.of(words, GRAM)
    return leftmost_least(grams, window - GRAM + 1), grams


def anchors(docs: DataFrame, *, key: str = "row", text: str = "text", window: int = 35) -> DataFrame:
    """(print, row, pos): each minimiser position once."""

    @F.arrow_udf("array<struct<print:long,pos:int>>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            sizes, prints, places = [0], [], []
            for value in batch.cast(pa.binary()):
                at, grams = minimisers(word_hashes().of((value.as_py() or b"").split()), window)
                pos = np.unique(at)
                sizes.append(len(pos))
                prints.append(grams[pos].view(np.int64) if len(pos) else np.zeros(0, np.int64))
                places.append(pos.astype(np.int32))
            rows = pa.StructArray.from_arrays([pa.array(np.concatenate(prints) if prints else np.zeros(0, np.int64)), pa.array(np.concatenate(places) if places else np.zeros(0, np.int32))], ["print", "pos"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rows)

    return docs.select(F.col(key).alias("row"), F.explode(found(F.col(text))).alias("a")).select("a.print", "row", "a.pos")


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _sorted_scans(spark: SparkSession):
    """Within it a scan of a bucketed table is known to be in order, as each bucket is one file."""
    return _set(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


class FingerprintIndex:
    """The index in a folder that all executors reach: made there, or opened as the last call left it."""

    MANIFEST = "version int, buckets int, window int, levels array<array<string>>, windows array<array<string>>"
    COLUMNS = {"run": "print BIGINT, n BIGINT", "windows": "print BIGINT, hash BIGINT, check BIGINT"}

    def __init__(self, spark: SparkSession, path: str, *, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.version, self.window = 0, None
        self.levels: list[list[str]] = []
        self.windows: list[list[str]] = []
        self._outdated: list[str] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        versions = [name for name in files_in(spark, f"{path}/manifest") if "_SUCCESS" in files_in(spark, f"{path}/manifest/{name}")]
        if versions:
            last = spark.read.schema(self.MANIFEST).json(f"{path}/manifest/{max(versions)}").first()
            self.version, self.buckets, self.window = last["version"], last["buckets"], last["window"]
            self.levels, self.windows = [list(level) for level in last["levels"]], [list(level) for level in last["windows"]]
            for name in [*self.runs, *self.window_runs]:
                columns = self.COLUMNS[name.split("_")[0]]
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{self._place(name)}'")

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    @property
    def window_runs(self) -> list[str]:
        return [run for level in self.windows for run in level]

    def _place(self, run: str) -> str:
        return f"{self.path}/runs/{run}"

    def _write(self, rows: DataFrame, kind: str = "run") -> str:
        """Rows dealt by print into as many parts as there are buckets, as a run of one sorted file per bucket."""
        name = f"{kind}_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").option("path", self._place(name)).bucketBy(self.buckets, "print").sortBy("print").saveAsTable(name)
        return name

    def _counted(self, batch: DataFrame) -> DataFrame:
        rows = batch.groupBy("print").agg(F.count("*").alias("n"))
        return rows if self.buckets == int(self.spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(self.buckets, "print")

    def merged(self, a: str, b: str, how: str = "inner") -> DataFrame:
        """Two runs as one by a merge join (to be planned within _sorted_scans): print and the n of both."""
        left, right = self.spark.table(a), self.spark.table(b)
        return left.hint("merge").join(right.withColumnRenamed("n", "m"), "print", how)

    def _insert(self, levels: list[list[str]], run: str, compacted, level: int = 0) -> None:
        """Puts a run into its level; a full level is compacted into one run of the next."""
        if level == len(levels):
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) == FANOUT:
            full = levels[level]
            with _sorted_scans(self.spark):
                run = compacted(*full)
            levels[level] = []
            self._outdated += full
            self._insert(levels, run, compacted, level + 1)

    def _sum(self, a: str, b: str) -> str:
        return self._write(self.merged(a, b, "full_outer").select("print", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))

    def _union(self, a: str, b: str) -> str:
        """Both runs of windows as one; a window of both stays once."""
        # A union of two bucketed scans claims their partitioning in Spark 4.1 but does not keep it, so duplicates would stay.
        with _set(self.spark, "spark.sql.unionOutputPartitioning", "false"):
            rows = self.spark.table(a).unionByName(self.spark.table(b)).repartition(self.buckets, "print").dropDuplicates(["print", "hash", "check"])
            return self._write(rows, "windows")

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the anchors of a batch as a run. Returns (print): those that history has too, or that the batch has twice."""
        run = self._write(self._counted(batch))
        seen = self.spark.table(run).filter("n > 1").select("print")
        with _sorted_scans(self.spark):
            for old in self.runs:
                seen = seen.unionByName(self.merged(run, old).select("print"))
            seen = saved(seen, "seen")
        self._insert(self.levels, run, self._sum)
        return seen

    def met(self, prints: DataFrame) -> DataFrame | None:
        """(hash, check): the windows of earlier calls that have one of these (print), by a merge join with each run of windows."""
        if not self.window_runs:
            return None
        asked = self._write(prints.select("print").repartition(self.buckets, "print"), "prints")
        self._outdated.append(asked)
        with _sorted_scans(self.spark):
            found = [self.meeting(run, asked) for run in self.window_runs]
            return saved(reduce(DataFrame.unionByName, found).distinct(), "met")

    def meeting(self, run: str, asked: str) -> DataFrame:
        """The join of one run (to be planned within _sorted_scans)."""
        return self.spark.table(run).hint("merge").join(self.spark.table(asked), "print").select("hash", "check")

    def remember(self, windows: DataFrame) -> None:
        """Keeps the windows (print, hash, check) of a call for later ones; equal ones are combined before they move."""
        rows = windows.groupBy("print", "hash", "check").agg(F.count("*").alias("n")).select("print", "hash", "check")
        self._insert(self.windows, self._write(rows.repartition(self.buckets, "print"), "windows"), self._union)

    def begin(self, window: int) -> None:
        if self.window not in (None, window):
            raise ValueError(f"this index is of windows of {self.window} words, not {window}")
        self.window, self._outdated = window, []

    def commit(self) -> None:
        """Writes the manifest; only then runs that were compacted go."""
        self.version += 1
        row = (self.version, self.buckets, self.window, self.levels, self.windows)
        self.spark.createDataFrame([row], self.MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/{self.version:09d}")
        for run in self._outdated:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            removed_folder(self.spark, self._place(run))
        self._outdated = []

    def close(self) -> None:
        """Forgets the runs' names in this session; the folder stays."""
        for run in [*self.runs, *self.window_runs, *self._outdated]:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def delete(self) -> None:
        self.close()
        removed_folder(self.spark, self.path)


def _flagged_windows(words: list[bytes], flagged: list[int], window: int) -> np.ndarray:
    """Starts of the windows whose minimiser is flagged."""
    at, _ = minimisers(word_hashes().of(words), window)
    return np.flatnonzero(np.isin(at, flagged))


def _window_hashes(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """128 bits of the bytes of each window, as rows of two numbers."""
    text = memoryview(b" ".join(words))
    place = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    low, high = place[starts].tolist(), (place[starts + window] - 1).tolist()
    return np.frombuffer(b"".join([xxh3_128_digest(text[a:e]) for a, e in zip(low, high, strict=True)]), np.int64).reshape(-1, 2)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _windows(window: int):
    shape = ("hash", "check", "pos")

    @F.arrow_udf("array<struct<hash:long,check:long,pos:int>>")
    def windows(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, flagged in pairs:
            sizes, hashes, places = [0], [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int32)]
            for value, at in zip(texts.cast(pa.binary()), flagged, strict=True):
                words = value.as_py().split()
                starts = _flagged_windows(words, at.as_py(), window)
                sizes.append(len(starts))
                hashes.append(_window_hashes(words, starts, window))
                places.append(starts.astype(np.int32))
            both = np.concatenate(hashes)
            rows = pa.StructArray.from_arrays([pa.array(c) for c in (both[:, 0].copy(), both[:, 1].copy(), np.concatenate(places))], shape)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rows)

    return windows


def all_windows(docs: DataFrame, *, text: str = "text", window: int = 35) -> DataFrame:
    """(print, hash, check) of every window of every text."""

    @F.arrow_udf("array<struct<print:long,hash:long,check:long>>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            sizes, prints, hashes = [0], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
            for value in batch.cast(pa.binary()):
                words = (value.as_py() or b"").split()
                at, grams = minimisers(word_hashes().of(words), window)
                sizes.append(len(at))
                if len(at):
                    prints.append(grams[at].view(np.int64))
                    hashes.append(_window_hashes(words, np.arange(len(at)), window))
            both = np.concatenate(hashes)
            rows = pa.StructArray.from_arrays([pa.array(c) for c in (np.concatenate(prints), both[:, 0].copy(), both[:, 1].copy())], ("print", "hash", "check"))
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rows)

    return docs.select(F.explode(found(F.col(text))).alias("w")).select("w.*")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 35, batches: int = 2, index: FingerprintIndex | None = None) -> DataFrame:
    """key, n_words, n_removed, kept_text, kept_sha256: every word covered by a window that starts anywhere else too goes.

    The documents join the index in batches by a hash of the row; what history and every batch hold decides about all of them.
    index: what earlier calls with it brought counts as history, and this call's documents are history for later ones; without
    one, an index is made for this call alone.
    """
    spark = docs.sparkSession
    lasting = index is not None
    index = index if lasting else FingerprintIndex(spark, f"{scratch_root(spark)}/index-{uuid.uuid4().hex}")
    index.begin(window)
    # Row numbers depend on the partitions of the input: they are given once, and every later step reads this table.
    base = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), "texts")
    every = saved(anchors(base, window=window), "anchors")
    # A print repeats if some batch has it twice or meets it in history; the older occurrences are flagged by the same list.
    seen = [index.add(every.filter(F.pmod(F.xxhash64("row"), F.lit(batches)) == k)) for k in range(batches)]
    # As a table, so that both sides of the join are plain exchanges and adaptive execution can split a print with many occurrences.
    repeated = saved(reduce(DataFrame.unionByName, seen).distinct(), "repeated")
    flags = every.join(repeated.hint("merge"), "print").groupBy("row").agg(F.collect_list("pos").alias("flags"))
    joined = saved(base.join(flags, "row", "left").withColumn("text", F.coalesce("text", F.lit(""))), "flagged")
    windows = _windows(window)
    some, none = joined.filter("flags is not null"), joined.filter("flags is null")
    checked = some.select("row", F.explode(windows("text", "flags")).alias("w")).select("w.hash", "w.check", "row", "w.pos", F.lit(True).alias("new"))
    if lasting:
        if (before := index.met(repeated)) is not None:
            nowhere = lambda kind: F.lit(None).cast(kind)
            checked = checked.unionByName(before.select("hash", "check", nowhere("long").alias("row"), nowhere("int").alias("pos"), F.lit(False).alias("new")))
        index.remember(all_windows(base, window=window))
        index.commit()
    else:
        index.delete()
    for table in (repeated, every, base):
        dropped(table)
    for table in seen:
        dropped(table)

    # Most flagged windows do repeat; only those that do not are sent on.
    single = checked.groupBy("hash", "check").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("pos").alias("pos"), F.max("new").alias("new")).filter("n = 1 and new")
    free = single.groupBy("row").agg(F.collect_list("pos").alias("free"))

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept_text:string,kept_sha256:string>")
    def removed(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, flagged, free in rows:
            out = []
            for value, at, let in zip(texts.cast(pa.binary()), flagged, free, strict=True):
                words = value.as_py().split()
                starts = _flagged_windows(words, at.as_py(), window)
                starts = starts[~np.isin(starts, let.as_py())] if let.is_valid else starts
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                stays = np.cumsum(edge[:-1]) == 0
                kept = [w for w, s in zip(words, stays, strict=True) if s]
                out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept_text": b" ".join(kept).decode(), "kept_sha256": _digest(kept)})
            yield pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())]))

    @F.arrow_udf("struct<n_words:long,kept_sha256:string>")
    def untouched(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            words = [(x.as_py() or b"").split() for x in batch.cast(pa.binary())]
            yield pa.StructArray.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array([_digest(w) for w in words], pa.string())], ["n_words", "kept_sha256"])

    cleaned = some.join(free, "row", "left").select("key", removed("text", "flags", "free").alias("r")).select("key", "r.*")
    kept_text = F.array_join(F.filter(F.split("text", "[ \\t-\\r]+", -1), lambda w: w != ""), " ")
    rest = none.select("key", untouched("text").alias("r"), kept_text.alias("kept_text")).select("key", "r.n_words", F.lit(0).cast("long").alias("n_removed"), "kept_text", "r.kept_sha256")
    return cleaned.unionByName(rest).withColumnRenamed("key", key)
