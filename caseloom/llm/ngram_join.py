"""N-gram Jaccard join of a corpus with itself, with Bayesian pruning of candidates.

A document is the set of its five-word shingles (lower-cased words: runs of ASCII letters and digits and of other characters beyond ASCII;
all its words as one shingle if it has one to four). Documents with one and the same set are one text: only its least id goes
on. MinHash signatures (128 values, 32 bands of 4: a pair at similarity 0.8 shares no band once in 2e7) give buckets.

Buckets that overlap are taken together: a component of documents linked by buckets is compared as a whole when that is no more pairs
than its buckets have one by one, so that a group of copies that meets in 30 bands is compared once; otherwise each
bucket is compared by itself, a pair only in the first band it shares. Groups are cut into blocks of ``BLOCK`` documents and each pair
of blocks is one unit of work, so a group of any size spreads; the pairs themselves are never rows.

Inside a unit all pairs are compared by MinHash values, 16 more at a time. With a uniform prior, m matches in k values leave the
posterior Beta(m+1, k-m+1); a pair whose probability of reaching the threshold falls below ``tolerance`` is dropped. Those that
stay are verified exactly on their shingle sets.

Defined results: null text or no word -> no links; such a document is a class of its own. Repeated rows are documents of
their own with equal text. An id names one document: where it stands on rows with different texts, the text whose
shingle set has the least digest decides for all of them. Rows with a null id have no links and null ids of text and class.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import dropped, saved
from .components import components
from .decontam import _FOLD
from .hashing import Windows, mixed, word_hashes

VALUES, BANDS, STEP, BLOCK = 128, 32, 16, 1024
#: Documents of small groups that make up one unit of work together.
UNIT = 1500
SHINGLE = 5
_rng = np.random.default_rng(20240601)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_windows = Windows(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_windows.of(word_hashes().of(words), min(SHINGLE, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 2048):
            h = (found[i : i + 2048, None] * _A[None, :] + _B[None, :]) >> np.uint64(32)
            least = np.minimum(least, h.min(axis=0).astype(np.uint32))
    return least


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """n x BANDS keys from n x VALUES signatures."""
    parts = sigs.reshape(len(sigs), BANDS, VALUES // BANDS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.full(parts.shape[:2], 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(parts.shape[2]):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


@lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For k compared values, the fewest matches at which a pair is kept."""

    def reaches(m: int, k: int) -> float:
        """P(J >= threshold) under Beta(m+1, k-m+1), as a binomial sum."""
        return sum(comb(k + 1, i) * threshold**i * (1 - threshold) ** (k + 1 - i) for i in range(m + 1))

    return {k: next(m for m in range(k + 1) if reaches(m, k) >= tolerance) for k in range(STEP, VALUES + 1, STEP)}


def signed(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, same, n, sig) of every row: same is a 128-bit digest of the shingle set, n its size."""

    @F.arrow_udf("struct<same:binary,n:int,sig:binary>")
    def sign(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            same, n, sigs = [], [], []
            for value in batch:
                found = shingles(value.as_py())
                same.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
                n.append(len(found))
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.StructArray.from_arrays([pa.array(same, pa.binary()), pa.array(n, pa.int32()), pa.array(sigs, pa.binary())], ["same", "n", "sig"])

    return docs.select(F.col(key).cast("long").alias("id"), sign(F.col(text)).alias("s")).select("id", "s.*")


def _bands(texts: DataFrame) -> DataFrame:
    @F.arrow_udf("array<long>")
    def keys(sigs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in sigs:
            raw = np.frombuffer(b"".join(batch.to_pylist()), np.uint32).reshape(-1, VALUES)
            found = band_keys(raw)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, BANDS, dtype=np.int32)), pa.array(found.ravel()))

    return texts.select("id", F.explode(keys("sig")).alias("band"))


def _survivors(a: np.ndarray, b: np.ndarray, mask: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs of rows of the signatures a and b stay; values are compared STEP at a time."""
    least = least_matches(threshold, tolerance)
    rows, cols = np.nonzero(mask)
    matches = np.zeros(len(rows), np.int16)
    for k in range(STEP, VALUES + 1, STEP):
        for at in range(0, len(rows), 1 << 18):
            r, c = rows[at : at + (1 << 18)], cols[at : at + (1 << 18)]
            matches[at : at + (1 << 18)] += (a[r, k - STEP : k] == b[c, k - STEP : k]).sum(axis=1, dtype=np.int16)
        stay = matches >= least[k]
        rows, cols, matches = rows[stay], cols[stay], matches[stay]
        if not len(rows):
            break
    return np.stack([rows, cols]) if len(rows) else np.zeros((2, 0), np.int64)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left[i]] and sets[right[i]]."""
    used = np.unique(np.concatenate([left, right]))
    if len(left) <= 4 * len(used):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    at = np.full(len(sets), -1)
    at[used] = np.arange(len(used))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.zeros((len(used), len(used)), np.float32)
    often = count > max(2, len(used) // 32)
    number = np.cumsum(often) - 1
    dense = often[column]
    rows, cols = owner[dense], number[column[dense]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for first in range(0, int(often.sum()), 2048):
        lo, hi = np.searchsorted(cols, [first, first + 2048])
        x = np.zeros((len(used), 2048), np.float32)
        x[rows[lo:hi], cols[lo:hi] - first] = 1
        shared += x @ x.T
    rare = ~dense & (count[column] > 1)
    order = np.argsort(column[rare], kind="stable")
    who, ends = owner[rare][order], np.flatnonzero(np.diff(column[rare][order])) + 1
    for members in np.split(who, ends) if len(who) else []:
        shared[np.ix_(members, members)] += 1
    return shared[at[left], at[right]].astype(np.int64)


def _one_text_each(rows: pd.DataFrame) -> pd.DataFrame:
    """Where an id came with several texts, the one that its shingle set's digest was made of."""
    member = ["grp", "by_band", "id"]
    several = rows.duplicated(member, keep=False)
    if not several.any():
        return rows
    right = [not s or xxh3_128_digest(shingles(t).tobytes()) == same for s, t, same in zip(several, rows["text"], rows["same"], strict=True)]
    return rows[right].drop_duplicates(member)


def _compared(threshold: float, tolerance: float):
    """Links of one unit of work: a row per document with a link, its weighted number and the least linked document."""

    def unit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _one_text_each(rows).sort_values(["grp", "by_band", "id"], ignore_index=True)
        sigs = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(-1, VALUES)
        ids, side, copies, band = rows["id"].to_numpy(), rows["side"].to_numpy(), rows["copies"].to_numpy(), rows["band"].to_numpy()
        texts: list[str] = rows["text"].tolist()
        ends = np.flatnonzero(np.diff(rows["grp"].to_numpy())) + 1
        out_id, out_n, out_root, out_texts = [], [], [], []
        for lo, hi in zip([0, *ends], [*ends, len(rows)], strict=True):
            n = hi - lo
            s, by = sigs[lo:hi], side[lo:hi]
            # Side 2 is a block compared with itself; 0 and 1 are two blocks of one group.
            mask = np.triu(np.ones((n, n), bool), 1)
            if by[0] != 2:
                mask &= by[:, None] != by[None, :]
            if rows["by_band"].iat[lo]:
                keys = band_keys(s)
                here = int(np.flatnonzero((keys == band[lo]).all(axis=0))[0]) if n > 1 else 0
                for k in range(here):
                    mask &= keys[:, k][:, None] != keys[:, k][None, :]
            left, right = _survivors(s, s, mask, threshold, tolerance)
            if not len(left):
                continue
            sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
            for i in np.unique(np.concatenate([left, right])):
                sets[i] = shingles(texts[lo + i])
            size = np.array([len(x) for x in sets])
            common = _common(sets, left, right)
            # Without division: common / (a + b - common) >= threshold.
            linked = common * (1 + threshold) >= threshold * (size[left] + size[right]) - 1e-9
            left, right = left[linked], right[linked]
            if not len(left):
                continue
            links, texts_linked = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(links, left, copies[lo:hi][right])
            np.add.at(links, right, copies[lo:hi][left])
            np.add.at(texts_linked, left, 1)
            np.add.at(texts_linked, right, 1)
            root = np.arange(n)
            while True:  # least label over links
                low = np.minimum(root[left], root[right])
                before = root.copy()
                np.minimum.at(root, left, low)
                np.minimum.at(root, right, low)
                root = root[root]
                if (root == before).all():
                    break
            for i in np.flatnonzero(texts_linked):
                out_id.append(ids[lo + i])
                out_n.append(links[i])
                out_texts.append(texts_linked[i])
                out_root.append(ids[lo + root[i]])
        return pd.DataFrame({"id": np.array(out_id, np.int64), "links": np.array(out_n, np.int64), "texts": np.array(out_texts, np.int64), "root": np.array(out_root, np.int64)})

    return unit


def _groups(texts: DataFrame) -> DataFrame:
    """(id, grp, band, by_band, size): what is compared with what. A document may be in several groups of the kind by_band."""
    bands = _bands(texts.select("id", "sig"))
    buckets = saved(bands.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("least")).filter("size > 1"), "buckets")
    members = saved(bands.join(buckets, "band"), "members")
    of = components(members.select("id", "least").distinct(), "id", "least")
    each = buckets.join(of.select(F.col("node").alias("least"), "component"), "least")
    pairs = lambda n: n * (n - 1) / 2
    apart = each.groupBy("component").agg(F.sum(pairs(F.col("size").cast("double"))).alias("apart"))
    sizes = of.groupBy("component").agg(F.count("*").alias("whole"))
    taken = saved(sizes.join(apart, "component").withColumn("by_band", pairs(F.col("whole").cast("double")) > F.greatest(F.col("apart"), F.lit(float(pairs(64))))), "components")
    as_whole = of.join(taken.filter("not by_band"), "component").select(F.col("node").alias("id"), F.col("component").alias("grp"), F.lit(0).cast("long").alias("band"), F.lit(False).alias("by_band"), F.col("whole").alias("size"))
    split = each.join(taken.filter("by_band").select("component"), "component").select("band")
    by_band = members.join(split, "band").select("id", F.col("band").alias("grp"), "band", F.lit(True).alias("by_band"), "size")
    return as_whole.unionByName(by_band)


def _units(groups: DataFrame) -> DataFrame:
    """groups with unit and side: small groups share a unit, of large ones each pair of blocks is one."""
    n = groups.filter(F.col("size") <= BLOCK).agg(F.count("*").alias("n")).first()["n"]
    shared = max(1, -(-n // UNIT))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")
    small = groups.filter(F.col("size") <= BLOCK).withColumn("unit", F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(shared)).cast("string"))).withColumn("side", F.lit(2))
    large = groups.filter(F.col("size") > BLOCK).withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.withColumn("unit", F.concat_ws("/", F.col("grp").cast("string"), F.col("by_band").cast("string"), F.least("_mine", "_other").cast("string"), F.greatest("_mine", "_other").cast("string")))
    large = large.withColumn("side", F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") < F.col("_other"), 0).otherwise(1))
    return small.unionByName(large.drop("_mine", "_other"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """One row per row of docs: id, text_id, class_id, n_links, n_texts.

    text_id: the least id with the same shingle set. class_id: the least id in the connected component of links. n_links: other
    documents at or above the threshold, copies counted one by one. n_texts: other texts at or above it.
    """
    every = saved(signed(docs, key=key, text=text), "signatures")
    owners = saved(every.filter("n > 0 and id is not null").groupBy("id").agg(F.min("same").alias("same"), F.count("*").alias("rows")), "owners")
    texts = saved(owners.groupBy("same").agg(F.min("id").alias("text_id"), F.sum("rows").alias("copies")), "texts")
    first = texts.withColumnRenamed("text_id", "id")
    # A repeated id has one row here: its rows of that set are equal.
    distinct = saved(every.filter("n > 0").join(first, ["same", "id"]).select("id", "same", "copies", "sig").dropDuplicates(["same", "id"]), "distinct")
    units = saved(_units(_groups(distinct)), "units")
    asked = units.select("id").distinct()
    # The same merge join at every size: were the ids sent round while they are few, the plan would change as the corpus grows.
    needed = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).hint("merge").join(asked, "id", "left_semi").dropDuplicates(["id", "text"])
    work = units.join(distinct, "id").join(needed, "id")
    found = saved(work.groupBy("unit").applyInPandas(_compared(threshold, tolerance), "id long, links long, texts long, root long"), "links")
    classes = saved(components(found.select("id", "root"), "id", "root").select(F.col("node").alias("text_id"), "component"), "classes")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("texts").alias("n_texts")).withColumnRenamed("id", "text_id")
    per_text = texts.join(counted, "text_id", "left").join(classes, "text_id", "left")
    rows = saved(every.select("id").join(owners.select("id", "same").join(per_text, "same"), "id", "left").drop("same"), "rows")
    for table in (every, owners, texts, distinct, units, found, classes):
        dropped(table)
    return rows.select(
        "id", F.coalesce("text_id", "id").alias("text_id"), F.coalesce("component", "text_id", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )
