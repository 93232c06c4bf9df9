"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; every row of the fitting folds, its label hidden, is unlabelled text. A linear score g is fitted to the
non-negative unbiased risk: with class prior ``pi`` and logistic loss l, ``pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])``.
Whenever the second part (the risk on negatives, estimated without any) falls below zero, which only overfitting can bring about, the
step goes against it instead of along the risk. The prior is the share of good rows among all labelled rows of the fitting folds; where only good rows are labelled
it is bounded from the two samples alone: the least ratio of unlabelled to positive rows above a score, over all scores of a first fit
at prior one half. Last, an intercept is set so that the mean probability of unlabelled rows is the prior.

Features read the whole text: words hashed to buckets, the shapes of words (letters, digits, cases, marks) and of pairs of neighbours,
each as the square root of its share, and bins of a few ratios (distinct words, repeated lines, commonest word, lengths).

Fitting takes at most ``max_positive`` positives and ``max_unlabelled`` rows in expectation (chosen by a hash of the key: the same rows
whatever the partitioning), whose features are written once, in blocks; each step is a Spark job in which tasks sum
the gradient of their blocks, so only a vector per task reaches the driver. Scoring reads every whole text where it lies: no shuffle.

Defined results: null text -> as an empty one, scored like any other. No positive among the fitting rows -> score 0.5 everywhere; positives but
no other unlabelled rows -> the same rows serve as both. A key labelled twice counts by its least label. Null keys and labels are never
learnt from. Repeated rows are rows of their own. Columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, held, saved
from .langid import held_out

WORDS, SHAPES, PAIRS, STEPS = 1 << 13, 1 << 10, 1 << 12, 20
#: Fixed order of the ratios that are binned.
RATIOS = ("distinct words", "distinct pairs", "distinct lines", "commonest word", "mean length", "words", "words a line")
#: Where each block of features starts; the last is the constant.
_AT_SHAPES, _AT_PAIRS, _AT_RATIOS = WORDS, WORDS + SHAPES, WORDS + SHAPES + PAIRS
SIZE = _AT_RATIOS + len(RATIOS) * (STEPS + 1) + 1
CACHE_WORDS = 200_000
_AGAIN = re.compile(r"(.)\1+", re.DOTALL)
_MIX = np.int64(2_654_435_761)


def shape(word: str) -> str:
    """Kinds of characters, each stretch of one kind once; marks as they are."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:64])
    return _AGAIN.sub(r"\1", "".join(kinds))


class Known(dict):
    """word -> a number, by which its bucket and the bucket of its shape are found; starts anew when it is full."""

    def __init__(self) -> None:
        self.bucket, self.shape = np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        if n >= len(self.bucket):
            self.bucket, self.shape = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.bucket, self.shape))
        self.bucket[n] = crc32(word.lower().encode()) % WORDS
        self.shape[n] = crc32(shape(word).encode()) % SHAPES
        return n


def features(text: str | None, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the features that are not zero."""
    if len(known) > CACHE_WORDS // 2:
        known.clear()
    runs = (text or "").split()
    if not runs:
        return np.array([SIZE - 1]), np.array([1.0])
    ids = np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))
    n = len(ids)
    _, times = np.unique(ids, return_counts=True)
    shapes = known.shape[ids]
    neighbours = shapes[:-1] * _MIX + shapes[1:]
    blocks = []
    for at, size, x, weight in ((0, WORDS, known.bucket[ids], 0.5), (_AT_SHAPES, SHAPES, shapes, 1.0), (_AT_PAIRS, PAIRS, (neighbours ^ (neighbours >> 15)) % PAIRS, 1.0)):
        count = np.bincount(x, minlength=size)
        places = np.flatnonzero(count)
        blocks.append((places + at, weight * np.sqrt(count[places] / max(1, len(x)))))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    pairs = len(np.unique(ids[:-1] * np.int64(len(known) + 1) + ids[1:])) / max(1, n - 1)
    ratios = (len(times) / n, pairs, len(set(lines)) / len(lines), times.max() / n, min(1.0, sum(map(len, runs)) / n / 20), min(1.0, np.log1p(n) / 12), min(1.0, n / len(lines) / 60))
    bins = _AT_RATIOS + np.arange(len(ratios)) * (STEPS + 1) + np.array([int(r * STEPS) for r in ratios])
    places, values = zip(*blocks, (bins, np.full(len(ratios), 0.5)), ([SIZE - 1], [1.0]), strict=True)
    return np.concatenate(places), np.concatenate(values)


def _known() -> Known:
    return held("quality", None, Known)


def _blocks(rows: DataFrame, text: str, docs_at_once: int = 512) -> DataFrame:
    """Features of rows (text, positive, unlabelled) as blocks of documents: bytes of the arrays that a step reads."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        for batch in batches:
            for at in range(0, batch.num_rows, docs_at_once):
                part = batch.slice(at, docs_at_once)
                found = [features(t.as_py(), known) for t in part.column(0)]
                of = np.repeat(np.arange(len(found), dtype=np.int32), [len(p) for p, _ in found])
                arrays = [of, np.concatenate([p for p, _ in found]).astype(np.int32), np.concatenate([v for _, v in found]).astype(np.float32)]
                arrays += [part.column(i).to_numpy(zero_copy_only=False).astype(np.int8) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], ["of", "place", "value", "positive", "unlabelled"])

    return rows.select(text, "positive", "unlabelled").mapInArrow(made, "of binary, place binary, value binary, positive binary, unlabelled binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    kinds = (np.int32, np.int32, np.float32, np.int8, np.int8)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield tuple(np.frombuffer(x, k).astype(np.float64 if k is np.float32 else np.int64) for x, k in zip(row, kinds, strict=True))


def _scores(w: np.ndarray, of: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, value * w[place], n)


def _sums(blocks: DataFrame, weights: np.ndarray, many: int) -> np.ndarray:
    """Sums over the blocks: positives' l(-g) and gradients of g and of l(-g), then the same of unlabelled rows' l(-g)."""
    sent = blocks.sparkSession.sparkContext.broadcast(weights)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, out = sent.value, np.zeros((3, SIZE + 1))
        for of, place, value, positive, unlabelled in _opened(batches):
            g = _scores(w, of, place, value, len(positive))
            p, loss = 1 / (1 + np.exp(-g)), np.logaddexp(0, g)
            for row, by, total in ((0, positive.astype(float), 0.0), (1, p * positive, (loss * positive).sum()), (2, p * unlabelled, (loss * unlabelled).sum())):
                out[row, :-1] += np.bincount(place, value * by[of], SIZE)
                out[row, -1] += total
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    found = blocks.coalesce(many).mapInArrow(summed, "sums binary").toLocalIterator()
    out = sum((np.frombuffer(r["sums"]).reshape(3, -1) for r in found), np.zeros((3, SIZE + 1)))
    sent.destroy()
    return out


def _descend(blocks: DataFrame, prior: float, positives: int, unlabelled: int, *, steps: int, rate: float, ridge: float, many: int) -> np.ndarray:
    """Weights by Adam over the whole sample, with the non-negative correction."""
    w, mean, square = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    for step in range(1, steps + 1):
        is_p, risk_p, risk_u = _sums(blocks, w, many)
        negative = risk_u[-1] / unlabelled - prior * risk_p[-1] / positives
        # l(g) = l(-g) - g, so the risk on positives has the gradient of l(-g) less that of g.
        along = risk_u[:-1] / unlabelled - prior * risk_p[:-1] / positives
        gradient = along + prior * (risk_p[:-1] - is_p[:-1]) / positives if negative >= 0 else -along
        gradient = gradient + ridge * np.append(w[:-1], 0.0)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w - rate * (1 - (step - 1) / steps) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


#: Bins of the histograms of scores: a sixteenth each, from -64 to 64.
_BINS, _REACH = 2048, 64.0


def _histograms(blocks: DataFrame, weights: np.ndarray, many: int) -> np.ndarray:
    """How many positives and unlabelled rows score in each bin."""
    sent = blocks.sparkSession.sparkContext.broadcast(weights)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, _BINS))
        for of, place, value, *kinds in _opened(batches):
            g = _scores(sent.value, of, place, value, len(kinds[0]))
            at = np.clip(((g + _REACH) * _BINS / (2 * _REACH)).astype(int), 0, _BINS - 1)
            out += [np.bincount(at, k, _BINS) for k in kinds]
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    return sum((np.frombuffer(r["sums"]).reshape(2, -1) for r in blocks.coalesce(many).mapInArrow(counted, "sums binary").toLocalIterator()), np.zeros((2, _BINS)))


def bounded_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from histograms of scores of positives and unlabelled rows: the least ratio of their shares above a score, with one deviation's room."""
    p, u = (np.cumsum(x[::-1]) / max(x.sum(), 1) for x in (positive, unlabelled))
    room = np.sqrt(1 / max(positive.sum(), 1)) + np.sqrt(1 / max(unlabelled.sum(), 1))
    few = p > 0.05
    return float(np.clip(((u + room * np.sqrt(u)) / np.maximum(p, 1e-9))[few].min(initial=1.0), 0.01, 0.99))


def _intercept(unlabelled: np.ndarray, prior: float) -> float:
    """What is added to scores so that their mean probability is the prior."""
    centre = (np.arange(_BINS) + 0.5) * 2 * _REACH / _BINS - _REACH
    low, high = -2 * _REACH, 2 * _REACH
    for _ in range(60):
        middle = (low + high) / 2
        few = (unlabelled / (1 + np.exp(-np.clip(centre + middle, -500, 500)))).sum() < prior * unlabelled.sum()
        low, high = (middle, high) if few else (low, middle)
    return low


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", prior: float | None = None, max_positive: int = 10_000, max_unlabelled: int = 20_000, steps: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray | None:
    """Weights from docs (key, text; all may be learnt from) and labels (key, 1 for trusted positives); None without positives."""
    least = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_good"))
    ids = docs.select(key).filter(F.col(key).isNotNull()).join(least, key, "left")
    n = ids.agg(F.count("*").alias("all"), F.count("_good").alias("labelled"), F.sum((F.col("_good") == 1).cast("long")).alias("good")).first()
    if not n["good"]:
        return None
    chosen = lambda most, total: F.pmod(F.xxhash64(F.lit("quality"), key), F.lit(1_000_000)) < int(min(1.0, most / total) * 1_000_000)
    picked = ids.withColumn("positive", F.coalesce(F.col("_good") == 1, F.lit(False)) & chosen(max_positive, n["good"])).withColumn("unlabelled", chosen(max_unlabelled, n["all"]))
    # At most max_positive + max_unlabelled ids (in expectation) go round; no text is moved to join a label.
    picked = picked.filter("positive or unlabelled").select(key, "positive", "unlabelled").distinct()
    blocks = saved(_blocks(docs.select(key, text).join(F.broadcast(picked), key), text), "quality")
    try:
        many = max(1, min(blocks.rdd.getNumPartitions(), blocks.sparkSession.sparkContext.defaultParallelism))
        descend = lambda pi: _descend(blocks, pi, p, u, steps=steps, rate=rate, ridge=ridge, many=many)
        p, u = (int(x) for x in _histograms(blocks, np.zeros(SIZE), many).sum(axis=1))
        if not p or not u:
            return None
        if prior is None:
            prior = n["good"] / n["labelled"] if n["good"] < n["labelled"] else bounded_prior(*_histograms(blocks, descend(0.5), many))
        w = descend(prior)
        w[-1] += _intercept(_histograms(blocks, w, many)[1], prior)
        return w
    finally:
        dropped(blocks)


def predict(docs: DataFrame, weights: np.ndarray | None, *, text: str = "text", least: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 from the least score on); all rows and other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(np.zeros(SIZE) if weights is None else weights)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, w = _known(), sent.value
        for batch in batches:
            g = np.array([values @ w[places] for places, values in (features(t.as_py(), known) for t in batch)], float)
            yield pa.array(1 / (1 + np.exp(-np.clip(g, -500, 500))), pa.float64())

    kept = docs.drop("score", "predicted")
    return kept.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= least).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", least: float = 0.3, **options: float) -> DataFrame:
    """Fits on the rows of docs that are not held out and scores all of them: docs with held_out, score, predicted."""
    weights = fit(docs.filter(~held_out(F.col(key))), labels, text=text, key=key, label=label, **options)
    return predict(docs.withColumn("held_out", held_out(F.col(key))), weights, text=text, least=least)
