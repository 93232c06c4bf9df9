"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (all its words if it has fewer). Patterns of
one length share a table of shifts keyed by a block of two words: a block that ends no pattern lets the search skip up
to length - 1 words; a block that does leads to a bucket of patterns by their suffix, within it by their first word, and
a direct comparison confirms. Documents are searched where they lie; there is no shuffle.

What is broadcast is checked: items go out in parts of at most ``part_windows`` windows and ``part_bytes`` bytes (one part for most
benchmarks); an item beyond a quarter of that goes out in several rows, which share all but one word of a window. Tables are arrays beside the
items' text, about 40 bytes for each window. With several parts the documents are searched once for each and the hits join in the row;
between parts they are kept as a table, so only one part is held at a time.

Defined results: null text -> no words, no hits. Items without words match nothing. Repeated items count once per
item_id. An item with a null id marks the words of its occurrences like others, but has no id to be listed or counted by. An empty benchmark -> nothing is contaminated.
"""

from __future__ import annotations

import math
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, saved

#: Bytes of words: A-Z become lower case, other ASCII except digits and letters a space; all else stays.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = "struct<n_words:long,spans:array<struct<start:int,end:int>>,items:array<string>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """Tables for all windows of ``length`` words in items (id, words); each window is a place in the items' own text, not a copy of it.

    Beside that text there are a fixed table of shifts by the hash of a block (two blocks of one hash share the lesser shift, which skips
    less and misses nothing) and one sorted array of windows by the hashes of their suffix block and of their first word.
    """

    def __init__(self, length: int, items: list[tuple[str | None, list[bytes]]], *, slots: int | None = None):
        self.length = m = length
        self.block = b = min(2, m)
        self.furthest = far = min(m - b + 1, 255)
        self.items = [i for i, _ in items]
        n = sum(len(w) for _, w in items)
        self.mask = (slots or 1 << min(24, max(12, (8 * n).bit_length()))) - 1
        self.shift = bytearray([far]) * (self.mask + 1)
        self.text = b" ".join(w for _, words in items for w in words)
        self.begin, self.first = array("Q", bytes(8 * (n + 1))), array("Q")
        keys, places, at, byte = np.empty(n, np.uint64), np.empty(n, np.uint32), 0, 0
        used = 0
        for _, words in items:
            self.first.append(at)
            hashes = [hash(w if b == 1 else words[i - 1] + b" " + w) & self.mask if i >= b - 1 else 0 for i, w in enumerate(words)]
            for i, w in enumerate(words):
                self.begin[at + i] = byte
                byte += len(w) + 1
            last = len(words) - m
            for i, h in enumerate(hashes[b - 1 :], b - 1):
                # A block that ends at word i ends the window before it at best, and comes sooner in none beyond the last.
                start = min(i - m + 1, last)
                skip = 0 if start >= 0 else min(-start, far)
                if i > last + m - 1 or last < 0:
                    continue
                if skip < self.shift[h]:
                    self.shift[h] = skip
            for start in range(last + 1):
                keys[used] = self._key(hashes[start + m - 1], words[start])
                places[used] = at + start
                used += 1
            at += len(words)
        self.begin[at] = byte
        order = np.argsort(keys[:used], kind="stable")
        self.keys, self.places = array("Q", keys[:used][order].tobytes()), array("I", places[:used][order].tobytes())

    @staticmethod
    def _key(suffix: int, first: bytes) -> int:
        return suffix << 32 | zlib.crc32(first)

    def memory(self) -> int:
        """Bytes of the tables."""
        return len(self.shift) + len(self.text) + sum(x.itemsize * len(x) for x in (self.begin, self.first, self.keys, self.places))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, str | None]]:
        """(start, item id) of every occurrence, once for each window of an item that it equals."""
        m, shift, mask, at, last = self.length, self.shift, self.mask, self.length, len(words)
        one, keys = self.block == 1, self.keys
        while at <= last:
            h = hash(words[at - 1] if one else words[at - 2] + b" " + words[at - 1]) & mask
            if skip := shift[h]:
                at += skip
                continue
            key = self._key(h, words[at - m])
            if (i := bisect_left(keys, key)) < len(keys) and keys[i] == key:
                here = b" ".join(words[at - m : at])
                while i < len(keys) and keys[i] == key:
                    place = self.places[i]
                    if self.text[self.begin[place] : self.begin[place + m] - 1] == here:
                        yield at - m, self.items[bisect_right(self.first, place) - 1]
                    i += 1
            at += 1


def tables(items: list[tuple[str | None, bytes]], window: int) -> list[WuManber]:
    by_length: dict[int, list[tuple[str | None, list[bytes]]]] = {}
    for item, text in items:
        if words := words_of(text):
            by_length.setdefault(min(window, len(words)), []).append((item, words))
    return [WuManber(n, some) for n, some in by_length.items()]


def _tables(value: tuple[int, list]) -> list[WuManber]:
    """Built once in a worker for each part that it meets last."""
    return held("patterns", id(value), lambda: (value, tables(value[1], value[0])))[1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def _searcher(sent):
    @F.arrow_udf(HITS)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shape = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
        built = _tables(sent.value)
        for batch in texts:
            out = []
            for value in batch.cast(pa.binary()):
                words = words_of(value.as_py() or b"")
                spans, found = [], set()
                for t in built:
                    for start, item in t.search(words):
                        spans.append((start, start + t.length))
                        found.add(item)
                found.discard(None)
                out.append({"n_words": len(words), "spans": [{"start": a, "end": e} for a, e in merged(spans)], "items": sorted(found)})
            yield pa.array(out, shape)

    return search


def _dealt(source: DataFrame, window: int, most_windows: int) -> DataFrame:
    """(item, bytes, windows): items of more windows than that in several rows, which share window - 1 words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = len(words) - min(window, len(words)) + 1 if words else 0
                rows += [(item, b" ".join(words[i : i + most_windows + window - 1]), min(most_windows, n - i)) for i in range(0, n, most_windows)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.string(), pa.binary(), pa.int64()))], ["item", "bytes", "windows"])

    return source.mapInArrow(cut, "item string, bytes binary, windows long")


def hits(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, part_windows: int = 1_000_000, part_bytes: int = 32 << 20
) -> DataFrame:
    """docs with n_words, n_hit, items (array of item ids as strings, sorted) and hit_spans (word positions, end exclusive)."""
    spark = docs.sparkSession
    source = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("binary").alias("bytes"))
    source = _dealt(source, window, max(1, part_windows // 4))
    size = source.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"), F.coalesce(F.sum(F.length("bytes")), F.lit(0)).alias("bytes")).first()
    full = max(size["windows"] / part_windows, size["bytes"] / part_bytes)
    parts = 1 if full <= 1 else math.ceil(2 * full)
    kept = [c for c in docs.columns if c not in ("_hits", "n_words", "n_hit", "items", "hit_spans")]
    out = docs.select(*kept)
    for k in range(parts):
        rows = source if parts == 1 else source.filter(F.pmod(F.xxhash64("item", "bytes"), F.lit(parts)) == k)
        sent = spark.sparkContext.broadcast((window, [(r["item"], bytes(r["bytes"])) for r in rows.collect()]))
        found = _searcher(sent)(F.col(text))
        if k == 0:
            out = out.withColumn("_hits", found)
        else:
            out = out.withColumn("_more", found).withColumn("_hits", F.struct(F.col("_hits.n_words").alias("n_words"), F.concat("_hits.spans", "_more.spans").alias("spans"), F.array_union("_hits.items", "_more.items").alias("items"))).drop("_more")
        if parts > 1:
            out = saved(out, "hits")
            sent.unpersist()
    covered = F.col("_hits.spans")
    if parts > 1:
        covered = _union(covered)
    out = out.withColumn("hit_spans", covered)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return out.select(*kept, "_hits.n_words", n_hit.alias("n_hit"), F.array_sort("_hits.items").alias("items"), "hit_spans")


def _union(spans: Column) -> Column:
    """Overlapping spans become one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    joined = lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(F.array_sort(spans), empty, joined)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", parts: int = 20) -> Column:
    """At least one word in ``parts`` lies in an occurrence."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * parts >= F.col(n_words))
