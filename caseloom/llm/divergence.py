"""Source divergence audit: how far the term shares of the sources of a language lie apart, by a frequent-pattern tree of term rows.

Terms are runs of letters (ASCII letters lower-cased, anything beyond ASCII as it is). A language keeps the terms that at least
``least_docs`` of its documents hold. In units of 1e-9 the smoothed share of a kept term is ``1 + floor(1e9 * (count + a) / (N + a * V))``
with a = ``smooth``, N the occurrences of kept terms and V their number. Two sources diverge by the sum over all kept terms of the
absolute difference of their shares; a source's own terms are those whose share lies above the language's.

Most counts are zero, so the sum is V times the difference of the shares of a count of zero, corrected for nonzero counts: once for each
count of one source as if the other had none, and once more for terms that both hold. The latter corrections come from a tree into
which each kept term goes as a row: its nonzero (source, share) items, in the order of the sources (those with the fewest occurrences
first, as low counts are shared by most terms). A node tells how many terms share its path, so what a node and one of its
ancestors correct is worked out once for all of them. Rows are dealt by range of their paths, so that rows with a shared beginning
meet in a task; each task has the tree of its rows, and sums over tasks are the sums over terms, wherever they lie.

Counting combines within each task before anything is shuffled, so a source with a third of all rows is a few rows per task and term.
Sums are exact: integers, decimals where a product could pass 64 bits. The tables of sources and of how often each has each share are
sent round while they have at most ``broadcast_groups`` rows, and joined beyond that. The result has a row for each pair of sources
of a language, and a term's row an item for each source that has it: it is meant for up to some 10,000 sources a language.

Defined results: null text, lang or source count as ''. A source without terms has V terms of count zero. A language without kept terms
has pairs of value 0 and no terms. Repeated rows count as often as they are there. Ties go to the item first in UTF-8. Extra
columns are ignored. An empty table -> no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, released, saved, whole

#: A term in UTF-8: anything but ASCII characters that are not letters.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Terms that a task counts before it passes them on.
TERMS_AT_ONCE = 200_000
#: Parts of a language's sources beyond the broadcast.
SALTS = 64


def count_terms(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; term is null in one row per source, with all its documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        seen: dict[tuple[str, str], tuple[Counter, Counter, list[int]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, holds, rows) in seen.items():
                terms = [None, *(t.decode() for t in n)]
                columns = [pa.array([x] * len(terms), pa.string()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([rows[0], *map(holds.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in batches:
            for value, a, b in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, holds, rows = seen.setdefault((a, b), (Counter(), Counter(), [0]))
                # bytes.lower() changes A to Z alone.
                here = Counter(_TERM.findall(value.as_py().encode().lower()))
                n.update(here)
                holds.update(here.keys())
                rows[0] += 1
            if sum(len(n) for n, _, _ in seen.values()) > TERMS_AT_ONCE:
                yield from flush()
        yield from flush()

    rows = docs.select(*[whole(F.col(c)).alias(c) for c in (text, lang, source)])
    found = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    # Dealt by term, so that counts by source and then the rows of terms need no further exchange.
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """The share of a count, exact; 1 in a language without kept terms. Reads the columns v and smooth too."""
    exact = f"((cast({count} + smooth as decimal(20,0)) * cast(1000000000 as decimal(10,0))) div cast({total} + smooth * v as decimal(20,0)))"
    return F.expr(f"cast(case when v > 0 then 1 + {exact} else 1 end as long)")


class _Tree:
    """A frequent-pattern tree of rows that come sorted: nodes of (source, share, share of a count of zero) with multiplicities."""

    def __init__(self) -> None:
        self.item: list[tuple[int, int, int]] = []
        self.parent: list[int] = []
        self.times: list[int] = []
        self.path: list[int] = []  # the nodes of the last row

    def insert(self, row: list[tuple[int, int, int]]) -> None:
        depth = 0
        for item, node in zip(row, self.path, strict=False):
            if self.item[node] != item:
                break
            self.times[node] += 1
            depth += 1
        del self.path[depth:]
        for item in row[depth:]:
            self.parent.append(self.path[-1] if self.path else -1)
            self.item.append(item)
            self.times.append(1)
            self.path.append(len(self.item) - 1)

    def corrections(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source of an ancestor, source of a node, what terms that both hold add beyond what each adds alone), summed by pair."""
        if not self.item:
            return (np.zeros(0, np.int64),) * 3
        source, p, z = np.array(self.item, np.int64).T
        up, times = np.array(self.parent, np.int64), np.array(self.times, np.int64)
        node, above, parts = np.arange(len(source)), up, []
        while len(node := node[above >= 0]):
            above = above[above >= 0]
            both = np.abs(p[node] - p[above]) - np.abs(p[node] - z[above]) - np.abs(z[node] - p[above]) + np.abs(z[node] - z[above])
            parts.append(_summed(source[above], source[node], times[node] * both))
            above = up[above]
        return _summed(*(np.concatenate(c) for c in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 3


def _summed(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(value[order], first)


def shared_corrections(paths: DataFrame, *, nodes_at_once: int = 300_000) -> DataFrame:
    """(lang, low, high, correction) of pairs of sources (numbers) from rows (lang, path: array<struct<at, p, z>> in order of at)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        tree, of = _Tree(), None

        def flush() -> pa.RecordBatch:
            low, high, value = tree.corrections()
            return pa.RecordBatch.from_arrays([pa.array([of] * len(low), pa.string()), pa.array(low), pa.array(high), pa.array(value)], ["lang", "low", "high", "correction"])

        for batch in batches:
            items = batch.column(1).flatten()
            flat = list(zip(*(items.field(i).to_pylist() for i in range(3)), strict=True))
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy()).tolist()
            for lang, begin, end in zip(batch.column(0).to_pylist(), [0, *ends], ends, strict=False):
                if lang != of or len(tree.item) > nodes_at_once:
                    yield flush()
                    tree, of = _Tree(), lang
                tree.insert(flat[begin:end])
        yield flush()

    dealt = paths.select("lang", "path").repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return dealt.mapInArrow(found, "lang string, low long, high long, correction long").groupBy("lang", "low", "high").agg(F.sum("correction").alias("correction"))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, smooth: int = 5, terms: int = 50, broadcast_groups: int = 100_000) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source its divergence from every other (``pair``) and its ``terms`` most overused terms (``term``)."""
    held = Window.partitionBy("lang")
    counts = count_terms(docs, text=text, lang=lang, source=source)
    rows = saved(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("items")).filter(F.col("term").isNull() | (F.col("docs") >= least_docs)), "term-rows")
    kept = rows.filter("term is not null")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
    each = kept.select("lang", "term", "total", F.explode("items").alias("i")).select("lang", "term", "total", F.col("i.source").alias("source"), F.col("i.n").alias("n"))
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    every = rows.filter("term is null").select("lang", F.explode("items.source").alias("source"))
    groups = every.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["group_n", "v", "all_n"]).withColumn("smooth", F.lit(smooth).cast("long"))
    numbered = groups.withColumn("at", F.row_number().over(held.orderBy("group_n", "source")).cast("long")).withColumn("z", _share("0", "group_n"))
    groups = saved(numbered, "groups")
    small = (lambda df: F.broadcast(df)) if groups.count() <= broadcast_groups else (lambda df: df)
    shared = each.join(small(groups), ["lang", "source"]).withColumn("p", _share("n", "group_n"))
    shares = saved(shared.withColumn("q", _share("total", "all_n")).select("lang", "source", "at", "term", "p", "z", "q"), "shares")

    best = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
    own = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(best("lang", "source"))).filter(F.col("rank") <= terms)

    both = shared_corrections(shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("at", "p", "z"))).alias("path")))
    # What the nonzero counts of one source add against a count of zero in another: from how often it has each share.
    often = saved(shares.groupBy("lang", "at", "p").agg(F.count("*").alias("times")), "often")
    as_list = often.groupBy("lang", "at").agg(F.collect_list(F.struct("p", "times")).alias("often"))
    one = groups.select("lang", "source", "at", "z", "v").join(as_list, ["lang", "at"], "left")
    other = one.select("lang", *[F.col(c).alias(f"other_{c}") for c in ("source", "at", "z", "often")])
    if max(groups.count(), often.count()) <= broadcast_groups:
        pairs = one.join(F.broadcast(other), "lang")
    else:  # the sources of a language in SALTS parts
        salted = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = one.withColumn("_salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"])
    pairs = pairs.filter("at < other_at")

    def alone(often: str, z: str, other: str) -> Column:
        against = F.abs(F.col(z) - F.col(other))
        return F.aggregate(F.coalesce(often, F.array().cast("array<struct<p:long,times:long>>")), F.lit(0).cast("long"), lambda s, x: s + x["times"] * (F.abs(x["p"] - F.col(other)) - against))

    value = F.col("v") * F.abs(F.col("z") - F.col("other_z")) + alone("often", "z", "other_z") + alone("other_often", "other_z", "z") + F.coalesce("correction", F.lit(0))
    sums = pairs.join(both.select("lang", F.col("low").alias("at"), F.col("high").alias("other_at"), "correction"), ["lang", "at", "other_at"], "left")
    sums = sums.select("lang", "source", "other_source", value.alias("value"))
    ways = F.array(F.struct("source", F.col("other_source").alias("item")), F.struct(F.col("other_source").alias("source"), F.col("source").alias("item")))
    apart = sums.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(best("lang", "source")))
    out = saved(apart.unionByName(own), "divergence")
    for table in (rows, groups, shares, often):
        dropped(table)
    return out
