"""Best-fit packing of documents into fixed-length sequences, improved by swap-based local search.

Documents become token ids once, where their texts lie; from then on only (key, piece, length) rows move. Pieces of
exactly the sequence length are sequences of their own. The rest is dealt evenly into blocks of about ``block``
pieces. In each block a best-fit-decreasing packing is the start. Local search then moves a document, or exchanges one for
one or two for one, between underfull bins, always in the way that raises the sum of squared fills most. It ends when the
block has no more bins than its tokens need (none can be emptied), or at a fixed point, where no move or exchange of any bin
raises that sum; a bin without a gain is looked at again only against bins that changed since, so a block's time is about in proportion to its
moves. What is left in underfull bins is dealt into new blocks once more and searched again, so the
bins that end a block underfull meet those of others. Both rounds have the same bounded block size at any scale.

Defined results: null text -> empty -> one piece with the end id alone. Repeated rows are packed as often as they
occur. An empty table -> no rows. Ties among documents of one length are settled by the order in the block. Columns named like
an output are replaced, all others stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_ids import chunk_ids
from .common import saved

#: Bytes that are encoded at once.
BATCH_BYTES = 1_000_000
#: Numbers in one matrix of exchanges.
MATRIX = 1 << 20


def pieces(docs: DataFrame, path: str, *, text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """docs without the text: one row per piece, with piece, start, length and ids_crc32."""

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shape = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        encoder, last = chunk_ids(path), np.array([end_id], "<u4").tobytes()
        width = 4 * capacity

        def of(texts: list[bytes]) -> Iterator[list[dict]]:
            for found in encoder.of(texts):
                ids = found + last
                yield [{"piece": i, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} for i, at in enumerate(range(0, len(ids), width)) for part in [ids[at : at + width]]]

        for batch in batches:
            out: list[list[dict]] = []
            waiting: list[bytes] = []
            size = 0
            for value in batch.cast(pa.binary()):
                waiting.append(value.as_py() or b"")
                size += len(waiting[-1])
                if size >= BATCH_BYTES:
                    out.extend(of(waiting))
                    waiting, size = [], 0
            out.extend(of(waiting))
            yield pa.array(out, shape)

    kept = [c for c in docs.columns if c not in (text, "piece", "start", "length", "ids_crc32")]
    return docs.select(*kept, F.explode(cut(F.col(text))).alias("_p")).select(*kept, "_p.*")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing; open bins are found by their free room through one bit mask."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if fits := mask >> n:
            room = n + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
            bins[b].append(int(i))
        else:
            room, b = capacity, len(bins)
            bins.append([int(i)])
        by_room[room - n].append(b)
        mask |= 1 << (room - n)
    return bins


class _Search:
    """A packing in arrays: fill by bin, and the bin of each document; when each bin changed last, and when it was last found without a gain."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.capacity, self.size = capacity, lengths
        self.members = [list(b) for b in bins]
        self.home = np.zeros(len(lengths), np.int64)
        for b, inside in enumerate(self.members):
            self.home[inside] = b
        self.fill = np.bincount(self.home, weights=lengths, minlength=len(bins)).astype(np.int64)
        self.clock = 0
        self.changed, self.seen = np.zeros(len(bins), np.int64), np.full(len(bins), -1, np.int64)

    def out_weights(self, src: int) -> dict[int, tuple[int, ...]]:
        """Weights of one and of two documents of a bin, each with the first documents of that weight."""
        mine = self.members[src]
        found: dict[int, tuple[int, ...]] = {}
        for i in mine:
            found.setdefault(int(self.size[i]), (i,))
        by_size = {}
        for i in mine:
            by_size.setdefault(int(self.size[i]), []).append(i)
        sizes = sorted(by_size)
        for k, u in enumerate(sizes):
            for v in sizes[k:]:
                if u != v:
                    found.setdefault(u + v, (by_size[u][0], by_size[v][0]))
                elif len(by_size[u]) > 1:
                    found.setdefault(u + v, tuple(by_size[u][:2]))
        return found

    def improve(self, src: int) -> bool:
        """Makes the move or exchange out of src that raises the sum of squares most; False if none raises it.

        A bin that had no gain and has not changed since is held against the bins that have: with all others it has none still.
        """
        fill, fs = self.fill, self.fill[src]
        since = -1 if self.changed[src] > self.seen[src] else self.seen[src]
        open_bins = (fill < self.capacity) & (fill > 0) & (self.changed > since)
        open_bins[src] = False
        self.seen[src] = self.clock
        if not open_bins.any():
            return False
        back = np.flatnonzero(open_bins[self.home])
        # Columns: a document that comes back, or none from a bin.
        none = np.flatnonzero(open_bins)
        at = np.concatenate([self.home[back], none])
        returned = np.concatenate([self.size[back], np.zeros(len(none), np.int64)])
        room, lead = self.capacity - fill[at], fill[at] - fs
        weights = self.out_weights(src)
        out = np.fromiter(weights, np.int64, len(weights))
        best, plan = 0, None
        step = max(1, MATRIX // len(at))
        for k in range(0, len(out), step):
            shift = out[k : k + step, None] - returned[None, :]
            gain = np.where((shift > 0) & (shift <= room), shift * (shift + lead), 0)
            top = int(gain.argmax())
            if gain.flat[top] > best:
                best = gain.flat[top]
                i, j = divmod(top, len(at))
                plan = (int(out[k + i]), j)
        if plan is None:
            return False
        weight, j = plan
        dst, given = int(at[j]), weights[weight]
        taken = (int(back[j]),) if j < len(back) else ()
        self.members[src] = [i for i in self.members[src] if i not in given] + list(taken)
        self.members[dst] = [i for i in self.members[dst] if i not in taken] + list(given)
        self.home[list(given)], self.home[list(taken)] = dst, src
        shift = weight - int(returned[j])
        self.fill[src] -= shift
        self.fill[dst] += shift
        self.clock += 1
        self.changed[src] = self.changed[dst] = self.clock
        return True


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each raising the sum of squared fills, until no bin can be emptied or none of them raises it; empty bins go."""
    needed = -(-int(lengths.sum()) // capacity)
    search = _Search(bins, lengths, capacity)
    improved = True
    while improved and np.count_nonzero(search.fill) > needed:
        improved = False
        # Least full first: those are the next to run empty. Each goes on until it has no gain left.
        for src in np.argsort(search.fill, kind="stable"):
            gained = False
            while 0 < search.fill[src] < capacity and search.improve(int(src)):
                gained = improved = True
            if gained and np.count_nonzero(search.fill) <= needed:
                break
    return [b for b in search.members if b]


def _packed(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        lengths = group["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        if (group["sequence_id"] >= 0).all():
            before = [list(x) for x in group.groupby("sequence_id").indices.values()]
            kept = local_search(before, lengths, capacity)
            bins = min(bins, kept, key=len)
        number, offset, fill = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                number[i], offset[i] = b, at
                at += lengths[i]
            fill[members] = at
        return group.assign(sequence_id=(group["_block"].to_numpy() << 24) + number, offset=offset, _fill=fill)

    return pack


def pack(cut: DataFrame, *, capacity: int = 2048, block: int = 4096, again: float = 0.97) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of at most capacity.

    block: pieces that are searched together. again: bins filled to less than this share meet in a second round.
    """
    rows = saved(cut.drop("sequence_id", "offset", "_block", "_fill", "_row"), "pieces")
    columns = [f"`{c}`" for c in rows.columns]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    part = rows.filter(F.col("length") < capacity)
    full = rows.filter(F.col("length") >= capacity)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["_block long", "sequence_id long", "offset long", "_fill long"])
    blocks = max(1, -(-part.count() // block))
    none = lambda n: F.lit(n).cast("long")
    dealt = part.withColumns({"_block": F.pmod(F.xxhash64(F.lit(1), "_row"), F.lit(blocks)), "sequence_id": none(-1), "offset": none(0), "_fill": none(0)})
    first = saved(dealt.groupBy("_block").applyInPandas(_packed(capacity), schema), "packed")
    underfull = F.col("_fill") < int(again * capacity)
    low = first.filter(underfull)
    more = max(1, -(-low.count() // block))
    second = low.withColumn("_block", blocks + F.pmod(F.xxhash64(F.lit(2), "sequence_id"), F.lit(more))).groupBy("_block").applyInPandas(_packed(capacity), schema)
    done = first.filter(~underfull).unionByName(second)
    # Numbers of full pieces lie below zero, apart from those of blocks.
    return done.select(*columns, "sequence_id", "offset").unionByName(full.select(*columns, (-1 - F.col("_row")).alias("sequence_id"), none(0).alias("offset")))
