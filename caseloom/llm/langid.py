"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. A word the model has never seen is scored by its
character n-grams instead: the longest n (5 down to 1) at which any of its n-grams is known, averaged over those
n-grams. Words are maximal runs of letters of the lower-cased text.

The model is fitted on a bounded sample of labelled rows (``max_train_docs`` in expectation, chosen by a hash of the
key, so the same rows whatever the partitioning) and holds at most ``max_words`` words and ``max_grams`` n-grams in
all, a like share for each language; that is the proven bound of what is broadcast. Prediction reads every whole text where it lies: no shuffle.

Defined results: null text or no letter -> ``und``, score 0. No labelled row at all -> ``und``, score 0 everywhere.
Rows with a null key or a null label are predicted but never learnt from. Ties go to the language first in code
point order. Repeated rows are rows of their own. Columns named like an output are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, released, saved

UNKNOWN = "und"
N_MAX = 5
SMOOTH = 0.5
#: Runs, and characters of runs, beyond known words that a task remembers the scores of: past half of them it starts anew.
CACHE_RUNS, CACHE_CHARS = 120_000, 4_000_000
#: Characters of texts, and new runs, that are scored together.
CHARS_AT_ONCE, RUNS_AT_ONCE = 500_000, 20_000
_LETTERS = regex.compile(r"\p{L}+")


def held_out(key: Column, folds: int = 5) -> Column:
    """True for rows that are never learnt from; a null key counts as held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id", max_train_docs: int = 20_000, max_words: int = 240_000, max_grams: int = 160_000) -> dict:
    """The model: {"langs", "words": {word: row}, "grams": {gram: row}, "scores": float32 rows}."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    total = rows.count()
    share = min(1.0, max_train_docs / max(total, 1))
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(share * 1_000_000))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            langs, words = zip(*seen, strict=True)
            return pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for value, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in _LETTERS.findall(value.as_py().lower()))
                if len(seen) > 200_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    words = saved(rows.select(text, label).mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams = None
    try:
        totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        langs = sorted(totals)
        if not langs:
            return {"langs": [], "words": {}, "grams": {}, "scores": np.zeros((0, 0), np.float32)}
        all_grams = words.mapInArrow(_gram_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        grams = saved(all_grams, "grams")
        top_words, top_grams = _top(words, langs, max_words), _top(grams, langs, max_grams)
    finally:
        for table in (words, grams):
            if table is not None:
                dropped(table)
    at = {lang: i for i, lang in enumerate(langs)}

    def table(found: list, size_of, count_of) -> tuple[dict[str, int], np.ndarray]:
        index: dict[str, int] = {}
        for r in found:
            index.setdefault(r["word"], len(index))
        n = np.zeros((len(index), len(langs)))
        for r in found:
            n[index[r["word"]], at[r["lang"]]] = r["n"]
        kinds = np.array([size_of(w) for w in index], dtype=np.int64)
        base = np.stack([count_of(k) for k in range(N_MAX + 1)]) if len(index) else np.ones((N_MAX + 1, len(langs)))
        return index, np.log((n + SMOOTH) / (base[kinds] + SMOOTH * max(len(index), 1))) if len(index) else np.zeros((0, len(langs)))

    of_words = np.array([totals[x] for x in langs], float)
    of_grams = np.ones((N_MAX + 1, len(langs)))
    for r in top_grams:
        of_grams[len(r["word"]), at[r["lang"]]] += r["n"]
    word_at, word_scores = table(top_words, lambda _: 0, lambda _: of_words)
    gram_at, gram_scores = table(top_grams, len, lambda k: of_grams[k])
    return {"langs": langs, "words": word_at, "grams": {g: i + len(word_at) for g, i in gram_at.items()}, "scores": np.vstack([word_scores, gram_scores]).astype(np.float32)}


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, n) from (lang, word, n): the n-grams of ``^word$`` for n up to N_MAX, a stretch of a long word at a time."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.string()), "word": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return out

    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            padded = f"^{word}$"
            for at in range(0, len(padded), 50_000):
                for k in range(1, N_MAX + 1):
                    for i in range(at, min(at + 50_000, len(padded) - k + 1)):
                        seen[lang, padded[i : i + k]] += n
                if len(seen) > 200_000:
                    yield flush()
    yield flush()


def _top(counts: DataFrame, langs: list[str], most: int) -> list:
    """The most frequent words of each language: all with a count from which on they are at most ``most / len(langs)``.

    The count is read from a histogram of counts, a few rows per language. Words of one count stay or go together, so nothing
    is ranked and no language is sorted in one task.
    """
    often = counts.filter("n > 1")
    histogram: dict[str, list[tuple[int, int]]] = {}
    for r in often.groupBy("lang", "n").agg(F.count("*").alias("words")).collect():
        histogram.setdefault(r["lang"], []).append((r["n"], r["words"]))
    least = {}
    for lang, found in histogram.items():
        total, least[lang] = 0, 1 + max(n for n, _ in found)
        for n, words in sorted(found, reverse=True):
            total += words
            if total > most // len(langs):
                break
            least[lang] = n
    if not least:
        return []
    border = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    return often.filter(F.col("n") >= border[F.col("lang")]).select("lang", "word", "n").collect()


class Scorer:
    """Scores texts in one worker: a table with one row of scores for each known word and for each other run that was met."""

    def __init__(self, model: dict):
        self.langs, self.words, self.grams, self.scores = model["langs"], model["words"], model["grams"], model["scores"]
        self.rows = np.zeros((len(self.scores) + CACHE_RUNS, len(self.langs) + 1), np.float32)
        self.rows[: len(self.scores), :-1] = self.scores
        self.rows[: len(self.scores), -1] = 1
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = dict(self.words)
        self.next, self.chars = len(self.scores), 0

    def known(self, word: str) -> list[int]:
        """The model's rows whose mean is the score of a word: its own, or those of its longest n-grams of which any is known."""
        if (row := self.words.get(word)) is not None:
            return [row]
        padded, get = f"^{word}$", self.grams.get
        for n in range(min(N_MAX, len(padded)), 0, -1):
            if rows := [r for i in range(len(padded) - n + 1) if (r := get(padded[i : i + n])) is not None]:
                return rows
        return []

    def learn(self, runs: list[str]) -> None:
        """Rows for runs between white space: the sum over the words of each, and how many they are."""
        if self.next + len(runs) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros((len(runs), self.rows.shape[1]), np.float32)])
        for a in range(0, len(runs), RUNS_AT_ONCE):
            some = runs[a : a + RUNS_AT_ONCE]
            rows, owner, share, words = [], [], [], []
            for i, run in enumerate(some):
                found = _LETTERS.findall(run)
                words.append(len(found))
                for word in found:
                    if n := len(known := self.known(word)):
                        rows += known
                        owner += [i] * n
                        share += [1 / n] * n
            first, last = self.next, self.next + len(some)
            parts = self.scores[np.array(rows, np.int64)] * np.array(share)[:, None]
            for j in range(len(self.langs)):
                self.rows[first:last, j] = np.bincount(owner, parts[:, j], len(some)) if owner else 0
            self.rows[first:last, -1] = words
            self.at.update(zip(some, range(first, last), strict=True))
            self.next = last
        self.chars += sum(map(len, runs))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; the runs that are new in these texts are scored together."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if self.next - len(self.scores) > CACHE_RUNS // 2 or self.chars > CACHE_CHARS:
            self.clear()
            if len(self.rows) > len(self.scores) + CACHE_RUNS:
                self.rows = self.rows[: len(self.scores) + CACHE_RUNS].copy()
        counts = [Counter((x or "").lower().split()) for x in texts]
        self.learn(list(dict.fromkeys(run for c in counts for run in c if run not in self.at)))
        return [self._best(c) for c in counts]

    def _best(self, counts: Counter) -> tuple[str, float]:
        if not counts:
            return UNKNOWN, 0.0
        rows = np.fromiter(map(self.at.__getitem__, counts), np.int64, len(counts))
        sums = np.fromiter(counts.values(), np.float64, len(counts)) @ self.rows[rows]
        words = sums[-1]
        if words < 1:
            return UNKNOWN, 0.0
        # Words of a text are not independent: a softmax over the raw sum would always say 1.
        p = np.exp((sums[:-1] - sums[:-1].max()) / np.sqrt(words))
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())

    def text(self, text: str | None) -> tuple[str, float]:
        return self.texts([text])[0]

    def batch(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """texts, some characters at a time."""
        waiting, size = [], 0
        for x in texts:
            waiting.append(x)
            size += len(x or "")
            if size >= CHARS_AT_ONCE:
                yield from self.texts(waiting)
                waiting, size = [], 0
        yield from self.texts(waiting)


def predict(docs: DataFrame, model: dict, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; all rows and other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        released()
        scorer = Scorer(sent.value)
        for batch in batches:
            found = list(scorer.batch(batch.to_pylist()))
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    kept = docs.drop("lang_pred", "score", "_scored")
    return kept.withColumn("_scored", scored(F.col(text))).select(*kept.columns, "_scored.lang_pred", "_scored.score")


def identify(docs: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id", **bounds: int) -> DataFrame:
    """Fits on the rows of docs that are not held out and predicts all of them: docs with held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out(F.col(key))), text=text, label=label, key=key, **bounds)
    return predict(docs.withColumn("held_out", held_out(F.col(key))), model, text=text)


def rejects(min_score: float = 0.0) -> Column:
    """What the language filter drops: texts in no language, or below a score."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_score)
