"""Vectors and exact nearest neighbours (VEC-4 to VEC-9, VEC-13 to VEC-15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import cut_at_space
from ..session import stored
from .pivots import PivotIndex


#: Texts that an encoder gets at once: a worker's memory does not grow with the batches that Spark makes.
AT_ONCE = 256


def normalise(v: Column) -> Column:
    """VEC-5: unit length in double; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def digest(vectors: Column) -> Column:
    """Sixteen bytes that vectors of the same elements share; null for null."""

    @F.arrow_udf("binary")
    def digested(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            found = [blake2b(flat[a:e].tobytes(), digest_size=16).digest() for a, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.array(found, pa.binary(), mask=batch.is_null().to_numpy(zero_copy_only=False))

    return digested(vectors)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(d2: Column) -> Column:
    """VEC-7."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + d2), 6)


def nearest(
    queries: DataFrame, index: DataFrame, k: int = 10, *, query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding",
    block: int = 1024, max_broadcast_mb: int = 64, pivots: int = 64,
) -> DataFrame:
    """VEC-6: (query_id, rank, vec_id, distance, similarity) of the k least squared distances; ties by vec_id.

    While ``max_broadcast_mb`` holds the queries, or their places that are not zero, they are sent round, and each task of the index keeps k
    candidates per query, by matrix products over blocks. Beyond that the index is dealt into cells around ``pivots``, of which each query meets only those that the
    triangle inequality leaves (``operators.pivots``), and nothing passes the driver. Either way the result is exact in double precision.

    Defined results: a vector that is null or empty, or that has a null, NaN or infinite element, has no neighbours and is no neighbour.
    Vectors of several dimensions are searched each among those of its own.
    """
    sizes = sorted(r["n"] for r in _sound(queries, query_id, vector).select(F.size("v").alias("n")).distinct().collect())
    parts = [_nearest(*[_sound(df, i, vector).filter(F.size("v") == n) for df, i in ((queries, query_id), (index, vector_id))], k, n, block, max_broadcast_mb, pivots) for n in sizes]
    found = parts[0] if parts else _sound(queries, query_id, vector).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("distance")).filter("false")
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), "rank", F.col("vec_id").alias(vector_id), "distance", similarity(F.col("distance")).alias("similarity"))


def _sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector can be compared."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return rows.filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _nearest(queries: DataFrame, index: DataFrame, k: int, dimension: int, block: int, max_broadcast_mb: int, pivots: int) -> DataFrame:
    """Candidates (query_id, vec_id, distance) of sound vectors (id, v) of one dimension."""
    seen = queries.agg(F.count("*").alias("n"), F.sum(F.size(F.filter("v", lambda x: x != 0))).alias("places")).first()
    if seen["n"] * dimension * 4 <= max_broadcast_mb << 20:
        rows = queries.toPandas()
        sent = rows["id"].to_numpy(), _matrix(rows["v"])
    elif seen["n"] * 16 + seen["places"] * 8 <= max_broadcast_mb << 20:
        sent = _collected(queries, dimension)
    else:
        # A query goes once to each cell it meets, so cells are not smaller than a unit of work.
        return PivotIndex(index, pivots=min(pivots, -(-index.count() // (8 * block))), block=block).search(queries, k, _least)
    shared = queries.sparkSession.sparkContext.broadcast(sent)
    return _spread(index).mapInPandas(_candidates(shared, k, block), "query_id long, vec_id long, distance double")


class _Sparse:
    """Vectors by their places that are not zero; rows taken from them are dense."""

    def __init__(self, ends: np.ndarray, places: np.ndarray, values: np.ndarray, dimension: int):
        self.ends, self.places, self.values, self.shape = ends, places, values, (len(ends) - 1, dimension)

    def __len__(self) -> int:
        return self.shape[0]

    def _flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number among rows, and the spot in places and values, of each place of rows."""
        begin, n = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        return np.repeat(np.arange(len(rows)), n), np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)

    def __getitem__(self, rows: slice | np.ndarray) -> np.ndarray:
        rows = np.arange(len(self))[rows]
        out = np.zeros((len(rows), self.shape[1]), np.float32)
        at, spot = self._flat(rows)
        out[at, self.places[spot]] = self.values[spot]
        return out

    def taken(self, rows: np.ndarray) -> _Sparse:
        at, spot = self._flat(rows)
        return _Sparse(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(rows)))]), self.places[spot], self.values[spot], self.shape[1])

    def alike(self) -> np.ndarray:
        """Row numbers such that rows with the same of the usual places stand together."""
        usual = np.flatnonzero(np.bincount(self.places, minlength=self.shape[1]) > len(self) / 50)
        has = np.zeros((len(self), len(usual)), bool)
        for i in range(0, len(self), 4096):
            has[i : i + 4096] = self[i : i + 4096][:, usual] != 0
        bits = np.packbits(has, axis=1)
        return np.lexsort(bits.T) if bits.shape[1] else np.arange(len(self))


def _collected(queries: DataFrame, dimension: int) -> tuple[np.ndarray, _Sparse]:
    """Ids and vectors of queries (id, v) at the driver, of which only places that are not zero pass to it."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, dimension)
            held = [np.flatnonzero(x).astype(np.int32) for x in v]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in held], pa.binary()), pa.array([x[c].tobytes() for x, c in zip(v, held, strict=True)], pa.binary())], ["id", "places", "vals"])

    rows = queries.select("id", "v").mapInArrow(packed, "id long, places binary, vals binary").toArrow()
    places, values = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("places", np.int32), ("vals", np.float32)))
    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in rows["places"].to_pylist()], dtype=np.int64)])
    all_of = _Sparse(ends.astype(np.int64), places, values, dimension)
    order = all_of.alike()
    return rows["id"].to_numpy()[order], all_of.taken(order)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows in at least as many parts as there are cores: each is met by all queries, however few bytes they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, "id") if rows.rdd.getNumPartitions() < cores else rows


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float32) if len(vectors) else np.zeros((0, 0), np.float32)


def _candidates(sent, k: int, block: int) -> Callable:
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _least(*sent.value, frames, k, block)

    return find


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, summed left to right in double, as a fold does."""
    out = np.zeros(len(qi))
    for i in range(0, len(qi), 8192):
        diff = np.ascontiguousarray((q[qi[i : i + 8192]].astype(np.float64) - x[xi[i : i + 8192]]).T)
        for c in diff:
            out[i : i + 8192] += c * c
    return out


def _first_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers without those that k rows with the same vector and lesser ids exclude from any k best."""
    seen: dict[bytes, int] = {}
    kept = []
    for i in np.argsort(ids, kind="stable"):
        seen[v] = n = seen.get(v := x[i].tobytes(), 0) + 1
        if n <= k:
            kept.append(i)
    return np.array(kept, np.int64)


def _products(q: np.ndarray, xt: np.ndarray) -> np.ndarray:
    """q @ xt: by the places that many rows of q have, and row by row at the others, where those are few."""
    there = q != 0
    often = there.mean(axis=0) > 0.25
    rest = there & ~often
    if rest.sum() * 24 + often.sum() * len(q) > q.size:
        return q @ xt
    out = q[:, often] @ xt[often]
    for i, c in zip(*np.nonzero(rest), strict=True):
        out[i] += q[i, c] * xt[c]
    return out


def _least(ids: np.ndarray, q: np.ndarray | _Sparse, frames: Iterator[pd.DataFrame], k: int, block: int, limit: np.ndarray | None = None) -> pd.DataFrame:
    """(query_id, vec_id, distance): for each query the k least of all rows by (exact distance, id), or those of them that are within its limit.

    A row is left out only if its approximate distance less its rounding bound lies above k others' approximate distances plus theirs,
    or above the k-th exact distance so far.
    """
    q2 = np.concatenate([np.zeros(0), *((q[i : i + block].astype(np.float64) ** 2).sum(axis=1) for i in range(0, len(q), block))])
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # number of the query, id, distance
    limit = np.full(len(q), np.inf) if limit is None else limit.copy()
    for frame in frames if len(q) else ():
        for at in range(0, len(frame), 8 * block):
            rows = frame.iloc[at : at + 8 * block]
            vid, x = rows.iloc[:, 0].to_numpy(), _matrix(rows.iloc[:, 1])
            some = _first_copies(vid, x, k)
            vid, x = vid[some], x[some]
            x2 = (x.astype(np.float64) ** 2).sum(axis=1)
            xt, half, most2 = np.ascontiguousarray(x.T), (x2 / 2).astype(np.float32) if x2.max() < 1e37 else None, x2.max()
            d = x.shape[1] + 8
            u = d * 2.0**-24
            new = [held]
            for i in range(0, len(q), block):
                part, rows2 = q[i : i + block], q2[i : i + block]
                most = limit[i : i + block]
                if half is None or rows2.max() >= 1e37:  # sums beyond what a float holds: all are measured
                    qi, xi = (c.ravel() for c in np.indices((len(part), len(vid))))
                    all_of = _exact(part, x, qi, xi).reshape(len(part), -1)
                    qi, xi = np.nonzero(all_of <= np.partition(all_of, min(k, len(vid)) - 1, axis=1)[:, min(k, len(vid)) - 1, None])
                else:
                    # near is q.x - x.x / 2, so that a distance is q.q less twice of it. Any order of summation: |fl(q.x) - q.x| <= g |q| |x| with
                    # g = d u / (1 - d u), u = 2**-24, of which d has room for the steps after it.
                    near = _products(part, xt)
                    near -= half
                    bound = u / (1 - u) * (np.sqrt(rows2 * most2) + most2) + 8 * d * 2.0**-53 * (rows2 + most2) + d * 2.0**-147
                    if len(vid) > k and not np.isfinite(most).all():
                        kth = np.partition(near, len(vid) - k, axis=1)[:, len(vid) - k]
                        most = np.minimum(most, rows2 - 2 * (kth - bound))
                    floor = (rows2 - most) / 2 - bound
                    with np.errstate(over="ignore"):
                        floor = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
                    qi, xi = np.divmod(np.flatnonzero(near >= floor[:, None]), len(vid))
                new.append((qi + i, vid[xi], _exact(part, x, qi, xi)))
            qi, found, distance = (np.concatenate(c) for c in zip(*new, strict=True))
            order = np.lexsort((found, distance, qi))
            qi, found, distance = qi[order], found[order], distance[order]
            place = np.arange(len(qi)) - np.searchsorted(qi, qi)
            limit[qi[place == k - 1]] = np.minimum(limit[qi[place == k - 1]], distance[place == k - 1])
            held = tuple(c[(place < k) & (distance <= limit[qi])] for c in (qi, found, distance))
    return pd.DataFrame({"query_id": ids[held[0]], "vec_id": held[1], "distance": held[2]})


def first_per_document(hits: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """VEC-8: the best chunk of each document, after the cut to k; a query may keep fewer than k."""
    best = Window.partitionBy(query_id, doc_id).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def supplement(hits: DataFrame, keyword: DataFrame, k: int = 10, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """VEC-9: hits with keyword rows (query_id, ordinal, doc_id) for the places left: (query_id, doc_id, rank, similarity, source).

    The places are cut first and ids already there (or repeated among the keyword rows) taken out after that, so a query may stay below k.
    Similarity 0. Ranks of keyword rows follow those of hits, which are at most k; of hits without a rank it is null.
    """
    hits = stored(hits, "hits")
    left = hits.groupBy(query_id).agg(F.count("*").alias("_have"))
    place = Window.partitionBy(query_id).orderBy("ordinal")
    more = keyword.select(query_id, "ordinal", doc_id).join(left, query_id, "left").withColumn("_at", F.row_number().over(place)).filter(F.col("_at") <= F.lit(k) - F.coalesce("_have", F.lit(0)))
    more = more.groupBy(query_id, doc_id).agg(F.min("_at").alias("_at")).join(hits.select(query_id, doc_id), [query_id, doc_id], "left_anti")
    rank = F.col("rank") if "rank" in hits.columns else F.lit(None).cast("int")
    base = hits.select(query_id, doc_id, rank.cast("int").alias("rank"), "similarity", F.lit("vector").alias("source"))
    return base.unionByName(more.select(query_id, doc_id, (F.col("_at") + k).cast("int").alias("rank"), F.lit(0.0).alias("similarity"), F.lit("keyword").alias("source")))


def distinct_documents(index: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """VEC-13."""
    return index.select(doc_id).distinct().orderBy(doc_id)


def index_stats(index: DataFrame, doc_id: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """VEC-14: total_documents and the size of the vectors in bytes."""
    return index.agg(F.countDistinct(doc_id).alias("total_documents"), F.coalesce(F.sum(F.size(vector) * 4), F.lit(0)).cast("long").alias("index_size_bytes"))


def snippets(text: Column) -> Column:
    """VEC-10: what a hit shows of its text: the semantic search's 300 characters, the keyword search's 500, the card's 200 cut at a blank."""
    return F.struct(F.substring(text, 1, 300).alias("semantic"), F.substring(text, 1, 500).alias("keyword"), cut_at_space(text, 200, "…").alias("card"))


def result_band(score: Column) -> Column:
    """VEC-15: colour and label of a similarity."""
    band = F.when(score > 0.8, "green").when(score > 0.6, "yellow").otherwise("default")
    label = F.when(score.isNull(), "—").otherwise(F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%")))
    return F.struct(band.alias("band"), label.alias("label"))


def encode(docs: DataFrame, encoder: Callable[[list[str]], np.ndarray], *, text: str = "text", out: str = "embedding") -> DataFrame:
    """VEC-4, VEC-5: docs with vectors at unit length by a pluggable encoder, a batch at a time; zero vectors stay."""

    def unit(v: np.ndarray) -> pa.Array:
        v = np.ascontiguousarray(v, np.float32)
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True)).astype(np.float32)
        flat = np.divide(v, norm, out=v.copy(), where=norm > 0).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, v.shape[1]), pa.int32()), pa.array(flat, pa.float32()))

    kept = docs.drop(out)
    at = kept.columns.index(text)

    # A map over batches: an expression could not take a text made by array functions.
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                found = unit(np.asarray(encoder([x or "" for x in some.column(at).to_pylist()])))
                yield pa.RecordBatch.from_arrays([*some.columns, found], [*some.schema.names, out])

    return kept.mapInArrow(vectors, T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))
