"""Exact nearest neighbours with pruning: an index of cells around pivots (VEC-6 for many queries).

Each vector lies in the cell of its nearest pivot, and a cell knows how near and how far its vectors lie from the pivot. A query first
meets the cells nearest to it that hold k vectors; the k-th distance found there is its limit. By the triangle inequality no vector of a cell is
nearer to the query than ``d(query, pivot) - farthest`` or ``nearest - d(query, pivot)``, so a cell whose bound lies above the limit is skipped
for that query, and what is found in the others is exact. Bounds give way by more than what rounding can do.

Cells and the queries that meet them are dealt into units of at most about ``8 * block`` rows a side, so a cell with a third of all
vectors is many units. Pivots are chosen farthest-first from a bounded sample; they change speed, never results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import removed, stored

SAMPLE = 2048
#: Bounds are taken less by this share of the distances that they are made of; each is exact to about 1e-13 of itself.
GIVE = 1e-9


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row of x to each pivot, by differences in double."""
    x = x.astype(np.float64)
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots.astype(np.float64)], axis=1)) if len(pivots) else np.zeros((len(x), 0))


def _farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    chosen = [0] if len(sample) else []
    nearest = np.full(len(sample), np.inf)
    while chosen and len(chosen) < n:
        nearest = np.minimum(nearest, distances(sample, sample[chosen[-1:]])[:, 0])
        if not nearest.max() > 0:
            break
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def met_cells(d: np.ndarray, cells: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, limit: np.ndarray | None) -> Iterator[np.ndarray]:
    """The cells that each query meets, from its distances d to the pivots and the cells' (least gap, greatest gap, vectors).

    With no limit yet the nearest cells that hold k vectors; then those others that may hold one within the limit.
    """
    near, far, count = cells
    held = count > 0
    for i, row in enumerate(d):
        order = np.argsort(np.where(held, row, np.inf), kind="stable")[: int(held.sum())]
        first = order[: int(np.searchsorted(np.cumsum(count[order]), k)) + 1]
        if limit is None:
            yield first
            continue
        bound = np.maximum(row - far, near - row) - GIVE * (row + far + near)
        yield np.setdiff1d(np.flatnonzero(held & (bound <= limit[i] * (1 + GIVE))), first)


class PivotIndex:
    """The cells of an index (id, v), written once; ``visited`` and ``cells_by_queries`` tell of the last search."""

    def __init__(self, index: DataFrame, *, pivots: int = 64, block: int = 1024):
        self.block = block
        self.visited = self.cells_by_queries = 0
        sample = index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
        self.pivots = chosen = _farthest_first(np.stack(sample.to_numpy()).astype(np.float32) if len(sample) else np.zeros((0, 0), np.float32), pivots)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = distances(_vectors(batch.column(1)), chosen)
                cell = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())], ["id", "v", "cell", "gap"])

        self.rows = stored(index.select("id", "v").mapInArrow(dealt, "id long, v array<float>, cell int, gap double"), "cells")
        n = len(chosen)
        self.near, self.far, self.count = np.zeros(n), np.full(n, -1.0), np.zeros(n, np.int64)
        for r in self.rows.groupBy("cell").agg(F.min("gap").alias("near"), F.max("gap").alias("far"), F.count("*").alias("n")).collect():
            self.near[r["cell"]], self.far[r["cell"]], self.count[r["cell"]] = r["near"], r["far"], r["n"]

    def _pairs(self, queries: DataFrame, k: int) -> DataFrame:
        """(id, v, limit, cell) for each cell that a query (id, v[, limit]) meets."""
        pivots, bounded = self.pivots, "limit" in queries.columns
        cells = self.near, self.far, self.count

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                limit = batch.column(2).to_numpy(zero_copy_only=False) if bounded else None
                met = list(met_cells(distances(_vectors(batch.column(1)), pivots), cells, k, limit))
                at = np.repeat(np.arange(len(met)), [len(c) for c in met])
                for i in range(0, len(at), 4096):
                    rows = batch.take(pa.array(at[i : i + 4096]))
                    most = rows.column(2) if bounded else pa.array(np.full(rows.num_rows, np.inf))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), most, pa.array(np.concatenate(met)[i : i + 4096], pa.int32())], ["id", "v", "limit", "cell"])

        return queries.mapInArrow(found, "id long, v array<float>, limit double, cell int")

    def _candidates(self, pairs: DataFrame, k: int, least: Callable) -> DataFrame:
        """(query_id, vec_id, distance): of each unit of a cell the k best for each of its queries."""
        asked = np.zeros(len(self.pivots), np.int64)
        for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect():
            asked[r["cell"]] = r["n"]
        self.visited += int(asked.sum())
        units = lambda n: F.element_at(F.array(*[F.lit(int(-(-max(1, x) // (8 * self.block)))) for x in n]), F.col("cell") + 1)
        own = lambda n: F.pmod(F.xxhash64("id"), units(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), units(n) - 1))
        left = pairs.select("id", "v", "limit", "cell", own(asked).alias("_q"), every(self.count).alias("_x"))
        right = self.rows.filter(F.element_at(F.array(*[F.lit(bool(x)) for x in asked]), F.col("cell") + 1)).select("id", "v", "cell", every(asked).alias("_q"), own(self.count).alias("_x"))
        block = self.block

        def pair(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            return least(q["id"].to_numpy(), np.stack(q["v"].to_numpy()).astype(np.float32) if len(q) else np.zeros((0, 0), np.float32), iter([x[["id", "v"]]]), k, block, (q["limit"].to_numpy() * (1 + GIVE)) ** 2)

        keys = ("cell", "_q", "_x")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, distance double")

    def search(self, queries: DataFrame, k: int, least: Callable) -> DataFrame:
        """(query_id, vec_id, distance) of queries (id, v): a few candidates for each, the k best among them."""
        self.visited, self.cells_by_queries = 0, queries.count() * int((self.count > 0).sum())
        if not len(self.pivots):
            return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
        # Pairs repeat a vector for each cell it meets: they are made twice, once to be counted, and never written.
        asked = stored(queries.select("id", "v"), "asked")
        found = stored(self._candidates(self._pairs(asked, k), k, least), "found")
        best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        kth = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k).select(F.col("query_id").alias("id"), F.sqrt("distance").alias("limit"))
        limited = stored(asked.join(kth, "id", "left").select("id", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit")), "limited")
        out = found.unionByName(stored(self._candidates(self._pairs(limited, k), k, least), "found"))
        for table in (asked, limited):
            removed(table)
        return out
