"""Periodic runs of words, by maximal pairs of the LCP-interval tree.

A run is a stretch of words with smallest period q and at least ``max(least_words, least_exponent * q)`` words that no neighbouring
word extends. Its first and second period start a maximal pair: two starts i and i + q whose suffixes share exactly l words and
whose left words differ. So runs are found as the maximal pairs with ``l >= max((least_exponent - 1) * q, least_words - q)``, and
need no extension: the run is ``i, q + l, q``. Multiples of q give the same stretch, of which the least is kept.

Texts in which some first words of a pair (``least_words - 1`` at these values) start twice near enough for a run take part; their
suffixes are sorted by doubling the words that ranks tell of, those of many texts at once. The intervals are visited bottom up;
each holds the starts below it, in lists by left word, and the smaller is merged into the larger, pairing starts of differing
left words. Starts that share l words within l / 3 of each other form one progression, in which all but the first have one left
word (the periodicity lemma), so one look to each side of a start finds its pairs, however many starts an interval has: time is
about n log n in the words of a text, and the pairs are at most a few for each run's periods.

Each text is one row's work: nothing is shuffled, and memory is in proportion to the longest text.

Defined results: null or empty text -> no words, no runs, an empty collapsed text. Repeated rows are rows of their own. Columns
named like an output are replaced. Bytes decide, so words that differ in case or normal form differ.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released

#: Words whose suffixes are sorted together; a longer text is sorted alone.
WORDS_AT_ONCE = 400_000
_K = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Numbers(dict):
    """bytes -> a number of its own."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Interval:
    """The starts below an LCP interval: all of them in order, and lists of them by left word."""

    __slots__ = ("lists", "starts")

    def __init__(self, start: int, left: int):
        self.starts = [start]
        self.lists = {left: [start]}

    def add(self, other: _Interval) -> None:
        if len(other.starts) == 1:
            insort(self.starts, other.starts[0])
        else:
            self.starts = sorted(self.starts + other.starts)
        for left, starts in other.lists.items():
            mine = self.lists.get(left)
            if mine is None:
                self.lists[left] = starts
            elif len(starts) == 1:
                insort(mine, starts[0])
            else:
                self.lists[left] = sorted(mine + starts)


def _joined(a: _Interval, b: _Interval, shared: int, reach: int, left: list[int], pairs: list[tuple[int, int, int]]) -> _Interval:
    """Both below one interval of ``shared`` words; its maximal pairs at most ``reach`` apart go to pairs: (start, distance, shared)."""
    if len(a.starts) < len(b.starts):
        a, b = b, a
    starts, lists = a.starts, a.lists
    for word, some in b.lists.items():
        for x in some:
            at = bisect_left(starts, x)
            # Before x only the first of the progression can have another left word.
            if at and x - starts[at - 1] <= reach:
                y = starts[bisect_left(starts, x - reach, 0, at)]
                if left[y] != word:
                    pairs.append((y, x - y, shared))
            # After x all have one left word: if it is another, its list has the pairs.
            if at < len(starts) and starts[at] - x <= reach and (other := left[starts[at]]) != word:
                mates = lists[other]
                pairs += [(x, y - x, shared) for y in mates[bisect_left(mates, x) : bisect_right(mates, x + reach)]]
    a.add(b)
    return a


def maximal_pairs(suffixes: list[int], shared: list[int], left: list[int], periods: int) -> list[tuple[int, int, int]]:
    """(start, distance, shared words) of the maximal pairs of which the shared words are at least ``periods`` times the distance.

    suffixes in order, shared[i] the words that suffixes i - 1 and i share (shared[0] is not read), left the word before each start.
    """
    pairs: list[tuple[int, int, int]] = []
    open_: list[list] = []  # intervals on the way to the last suffix: [shared words, starts so far]
    last = _Interval(suffixes[0], left[suffixes[0]])
    for i in range(1, len(suffixes) + 1):
        h = shared[i] if i < len(suffixes) else -1
        while open_ and open_[-1][0] > h:
            words, before = open_.pop()
            last = _joined(before, last, words, words // periods, left, pairs)
        if i == len(suffixes):
            break
        if open_ and open_[-1][0] == h:
            open_[-1][1] = _joined(open_[-1][1], last, h, h // periods, left, pairs)
        else:
            open_.append([h, last])
        last = _Interval(suffixes[i], left[suffixes[i]])
    return pairs


def _keys(x: np.ndarray, gram: int) -> np.ndarray:
    """A number for each gram of words, the same for equal grams."""
    n = len(x) - gram + 1
    key = np.zeros(n, np.uint64)
    for j in range(gram):
        key = (key + x[j : j + n].view(np.uint64) + np.uint64(1)) * _K
        key ^= key >> np.uint64(29)
    return key


def _with_near_repeats(x: np.ndarray, text: np.ndarray, reach: np.ndarray, gram: int) -> np.ndarray:
    """The texts (numbers) in which a gram starts twice within the text's reach: only these can have a run."""
    if len(x) < gram:
        return np.zeros(0, np.int64)
    keys = _keys(x, gram)
    order = np.argsort(keys, kind="stable")
    # Equal grams have equal keys; a collision only lets a text in that has no run.
    near = (keys[order[1:]] == keys[order[:-1]]) & (text[order[1:]] == text[order[:-1]]) & (order[1:] - order[:-1] <= reach[text[order[:-1]]])
    return np.unique(text[order[1:][near]])


def _sorted_suffixes(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes, text by text and in order of their words, by doubling the words that ranks tell of."""

    def places(new: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    order = np.lexsort((x, text))
    new = np.concatenate([[True], (x[order[1:]] != x[order[:-1]]) | (text[order[1:]] != text[order[:-1]])])
    rank = np.empty(len(x), np.int64)
    rank[order] = places(new)
    k = 1
    while True:
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
        # A start that shares k words with another has k words before its text's end, which is a word of its own.
        active = order[np.repeat(size > 1, size)]
        if not len(active):
            return np.argsort(rank, kind="stable")
        order = active[np.lexsort((rank[active + k], rank[active]))]
        first, second = rank[order], rank[order + k]
        group = np.concatenate([[True], first[1:] != first[:-1]])
        new = group | np.concatenate([[True], second[1:] != second[:-1]])
        rank[order] = first + places(new) - places(group)
        k *= 2


def _shared_words(x: list[int], text: np.ndarray, suffixes: np.ndarray) -> list[int]:
    """Words that each suffix shares with the one before it in order, 0 for the first of a text; by Kasai's walk in text order."""
    before = np.full(len(x), -1, np.int64)
    same = text[suffixes[1:]] == text[suffixes[:-1]]
    before[suffixes[1:][same]] = suffixes[:-1][same]
    shared, h = [0] * len(x), 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        while x[i + h] == x[j + h]:
            h += 1
        shared[i] = h
        if h:
            h -= 1
    return np.array(shared, np.int64)[suffixes].tolist()


def runs_of(texts: list[list[int]], *, least_words: int = 6, least_exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of word numbers, by start and then period."""
    if least_exponent < 3:
        raise ValueError("least_exponent must be 3 or more")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    periods = least_exponent - 1
    gram = min(max(periods * q, least_words - q) for q in range(1, max(2, least_words)))
    if not texts:
        return out
    # One text after another, a word of its own after each; a run's period is at most its share of a text.
    lengths = np.array([len(t) for t in texts], np.int64)
    x, text = _end_to_end(texts, lengths)
    kept = _with_near_repeats(x, text, lengths // least_exponent, gram)
    if not len(kept):
        return out
    x, text = _end_to_end([texts[i] for i in kept], lengths[kept])
    begins = (np.cumsum(lengths[kept] + 1) - lengths[kept] - 1).tolist()
    words = x.tolist()
    suffixes = _sorted_suffixes(x, text)
    shared = _shared_words(words, text, suffixes)
    left, listed, text = [-1, *words[:-1]], suffixes.tolist(), text.tolist()
    # What shares fewer words than a gram separates intervals that matter.
    borders = [*np.flatnonzero(np.array(shared) < gram).tolist(), len(listed)]
    found: dict[tuple[int, int], int] = {}
    for a, b in zip(borders, borders[1:], strict=False):
        if b - a > 1:
            for start, period, both in maximal_pairs(listed[a:b], shared[a:b], left, periods):
                if both + period >= least_words:
                    key = (start, both + period)
                    found[key] = min(period, found.get(key, period))
    for (start, length), period in sorted(found.items(), key=lambda f: (f[0][0], f[1])):
        i = text[start]
        out[kept[i]].append((start - begins[i], length, period))
    return out


def _end_to_end(texts: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of the text of each): all texts, each with an end that is a word of its own."""
    x = np.fromiter((w for i, t in enumerate(texts) for w in (*t, -1 - i)), np.int64, int(lengths.sum()) + len(texts))
    return x, np.repeat(np.arange(len(texts)), lengths + 1)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run has after its first period, with single blanks."""
    if runs:
        goes = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            goes[start + period] += 1
            goes[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(goes[:-1]).tolist(), strict=True) if not n]
    return b" ".join(words).decode()


def find_runs(docs: DataFrame, *, text: str = "text", least_words: int = 6, least_exponent: int = 4) -> DataFrame:
    """docs with runs: array<struct<start, length, period>> by start and then period, and collapsed: the text without repeats of a run's first period.

    Words are runs of anything but ASCII white space, numbered from 0. least_exponent is 3 or more.
    """

    @F.arrow_udf("struct<runs:array<struct<start:long,length:long,period:long>>,collapsed:string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        released()

        def of(some: list[list[bytes]]) -> Iterator[dict]:
            number = _Numbers().__getitem__
            runs = runs_of([list(map(number, words)) for words in some], least_words=least_words, least_exponent=least_exponent)
            for words, r in zip(some, runs, strict=True):
                yield {"runs": [{"start": s, "length": n, "period": q} for s, n, q in r], "collapsed": _collapsed(words, r)}

        for batch in batches:
            out, some, size = [], [], 0
            for value in batch:
                words = (value.as_py() or "").encode().split()
                if some and size + len(words) > WORDS_AT_ONCE:
                    out += of(some)
                    some, size = [], 0
                some.append(words)
                size += len(words)
            out += of(some)
            yield pa.array(out, pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())]))

    kept = docs.drop("runs", "collapsed", "_found")
    return kept.withColumn("_found", found(F.col(text))).select(*kept.columns, "_found.*")


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the least start, then the least period. Null without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q"), r.alias("run")))
    return F.array_min(order)["run"]


def listed(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
