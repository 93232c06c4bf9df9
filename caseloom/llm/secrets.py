"""Secret scanning: fixed base patterns, and a battery of randomness tests on further long strings.

Base spans come from three patterns (assignments, access keys, hex runs). Further candidates are runs of
``[A-Za-z0-9+/_-]``, with one or two ``=`` as closing padding, of at least ``min_len`` characters outside base spans. A run that
fits no alphabet, meets a base span or fails the battery as a whole is split at ``/``, ``_`` and ``-``, and its parts of that
length are the candidates. For each the encoding is inferred from its
characters (decimal, hex, base32, base64) and four tests give p-values under "uniform over that alphabet": chi-squared of symbol
counts, Wald-Wolfowitz runs about the alphabet's middle, lag-one serial correlation, and runs of kinds of characters (capitals,
small letters, digits), of which words and words with numbers have too few. They are combined by Bonferroni (four times the least).

False discoveries are controlled by class: letters, digits or both, by length. Decoys are what benign text makes of each: all its words joined
without space; all its numbers joined; and each number with the word before it, as in ``Section12Paragraph7``. All of them, outside base spans
and runs long enough to be candidates, are cut into stretches of every candidate length up to 255 and put through the same battery. Within a
class the p-value cutoff is the lowest at which decoys that pass are at most ``fdr`` of candidates that pass, were all candidates benign. A
class without decoys is judged by those of its characters in all lengths, then by all; a corpus without any can't be controlled, so nothing beyond
base spans is reported. ``least_bin`` is a floor that no cutoff goes below. The counts behind it cover all rows; only a table of
classes by score bins (of fixed size) reaches the driver.

Defined results: null text -> empty: no spans. Repeated rows are rows of their own. Columns named like an output are replaced. Overlaps of kinds are all reported; within a kind matches are leftmost
and do not overlap. Positions are code points, end exclusive. No candidates at all -> only base spans.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
_PART = re.compile(r"[A-Za-z0-9+]+={0,2}")
_WORDS = re.compile(r"[A-Za-z]+")
_TOKENS = re.compile(r"[A-Za-z]+|[0-9]+")

#: The alphabets that a candidate's encoding is inferred from, narrowest first.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("BASE36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_PLACES = [(name, {c: i for i, c in enumerate(letters)}) for name, letters in ALPHABETS]
#: Length classes (least length of each), times letters, digits or both; and score bins of the table that the cutoffs are read from.
LENGTHS = (16, 24, 32, 48, 64, 128)
LETTERS, DIGITS, BOTH = 0, 1, 2
CLASSES = 3 * len(LENGTHS)
BINS = 60
#: The usual floor: no cutoff lies below this bin, so a whole run below it is never reported.
LEAST_BIN = int(BINS * 9.5 / 12)
#: Decoys of the last class are shorter than this.
LONGEST_DECOY = 256
#: Decoys that are scored together.
DECOYS_AT_ONCE = 50_000


def _kind(c: str) -> int:
    return 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3


_KIND = np.array([_kind(chr(i)) for i in range(128)], np.int8)
_PLACE = np.full((len(ALPHABETS), 128), -1, np.int64)
#: By alphabet: its size, the chance that two neighbours differ in kind, and that both of two neighbouring pairs do.
_CHANGE: list[tuple[int, float, float]] = []
for _i, (_, _letters) in enumerate(ALPHABETS):
    _PLACE[_i, [ord(c) for c in _letters]] = range(len(_letters))
    _q = [sum(_kind(c) == k for c in _letters) / len(_letters) for k in range(4)]
    _CHANGE.append((len(_letters), 1 - sum(q * q for q in _q), sum(q * (1 - q) ** 2 for q in _q)))
_erfc = np.frompyfunc(math.erfc, 1, 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _chi2_tail(x: float, k: int) -> float:
    """Wilson-Hilferty's approximation of the upper tail of chi-squared."""
    z = ((max(x, 1e-9) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(s: str) -> float:
    """The combined p-value under uniform randomness over the inferred alphabet; 0 if no alphabet fits."""
    core = s.rstrip("=")
    held = set(core)
    which = next((i for i, (_, p) in enumerate(_PLACES) if held <= p.keys()), None)
    if which is None or len(core) < 8:
        return 0.0
    places = _PLACES[which][1]
    x, n, k = [places[c] for c in core], len(core), len(places)
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    p_chi = _chi2_tail(sum(c * c for c in counts.values()) * k / n - n, k - 1)
    high = [v * 2 >= k for v in x]
    a = sum(high)
    b = n - a
    if not a or not b:
        return 0.0
    runs = 1 + sum(u != v for u, v in zip(high, high[1:], strict=False))
    mean = 2 * a * b / n + 1
    var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    r = sum((u - m) * (v - m) for u, v in zip(x, x[1:], strict=False)) / spread if spread else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    kinds = [_KIND[ord(c)] for c in core]
    p_kinds = _kinds_tail(sum(u != v for u, v in zip(kinds, kinds[1:], strict=False)), n, which)
    return max(0.0, min(1.0, 4 * min(p_chi, p_runs, p_serial, p_kinds)))


def _kinds_tail(changes: int, n: int, which: int) -> float:
    """The chance of so few changes of kind between neighbours; 1 in an alphabet of one kind."""
    _, one, both = _CHANGE[which]
    if not one:
        return 1.0
    var = (n - 1) * one * (1 - one) + 2 * (n - 2) * (both - one * one)
    return 0.5 * math.erfc(((n - 1) * one - changes) / math.sqrt(2 * max(var, 1e-9)))


def batteries(strings: list[str]) -> np.ndarray:
    """battery() of ASCII strings of one length without padding, together."""
    n = len(strings[0])
    chars = np.frombuffer("".join(strings).encode("ascii"), np.uint8).reshape(-1, n)
    out, left = np.zeros(len(chars)), np.arange(len(chars))
    for which, (k, _, _) in enumerate(_CHANGE):
        fits = (_PLACE[which][chars[left]] >= 0).all(axis=1)
        mine, left = left[fits], left[~fits]
        if len(mine) and n >= 8:
            out[mine] = _fitting(_PLACE[which][chars[mine]], _KIND[chars[mine]], k, which)
    return out


def _fitting(x: np.ndarray, kinds: np.ndarray, k: int, which: int) -> np.ndarray:
    rows, n = x.shape
    counts = np.bincount((np.arange(rows)[:, None] * k + x).reshape(-1), minlength=rows * k).reshape(rows, k)
    chi = (counts.astype(float) ** 2).sum(axis=1) * k / n - n
    tail = lambda z: _erfc(z).astype(float)
    d = k - 1
    p_chi = 0.5 * tail(((np.maximum(chi, 1e-9) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)) / math.sqrt(2))
    high = x * 2 >= k
    a = high.sum(axis=1).astype(float)
    b = n - a
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 2 * a * b / n + 1
    p_runs = tail(np.abs(runs - mean) / np.sqrt(2 * np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    off = x - x.mean(axis=1, keepdims=True)
    spread = (off**2).sum(axis=1)
    r = np.where(spread > 0, (off[:, 1:] * off[:, :-1]).sum(axis=1) / np.maximum(spread, 1e-300), 1.0)
    p_serial = tail(np.abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    changes = (kinds[:, 1:] != kinds[:, :-1]).sum(axis=1)
    p_kinds = np.array([_kinds_tail(c, n, which) for c in range(n)])[changes]
    return np.where((a > 0) & (b > 0), np.clip(4 * np.minimum.reduce([p_chi, p_runs, p_serial, p_kinds]), 0.0, 1.0), 0.0)


def class_of(s: str) -> int:
    core = s.rstrip("=")
    of = DIGITS if core.isdigit() else BOTH if any(c.isdigit() for c in core) else LETTERS
    return of * len(LENGTHS) + max(i for i, least in enumerate(LENGTHS) if len(s) >= least)


def score_bin(p: float) -> int:
    """Bins of equal width in log p over [1e-12, 1]; the last holds the most random."""
    return min(BINS - 1, max(0, int((12 + math.log10(max(p, 1e-12))) / 12 * BINS)))


def candidates(s: str, base: list[tuple[int, int, int]], min_len: int = 20, least_bin: int = LEAST_BIN) -> list[tuple[int, int, int]]:
    """(start, end, score bin) of the candidates outside base spans."""

    # Base spans come sorted by their start; of those that start before a place the furthest end tells of an overlap.
    starts, furthest = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))

    def scored(a: int, e: int) -> list[tuple[int, int, int]]:
        before = bisect_left(starts, e)
        if e - a < min_len or (before and furthest[before - 1] > a):
            return []
        return [(a, e, score_bin(battery(s[a:e])))]

    out = []
    for m in _LONG.finditer(s):
        if m.end() - m.start() >= min_len:
            run = scored(*m.span())
            if not run or run[0][2] < least_bin:
                run = [c for p in _PART.finditer(s, *m.span()) for c in scored(*p.span())] or run
            out += run
    return out


def decoy_sources(s: str, base: list[tuple[int, int, int]], min_len: int = 20) -> list[str]:
    """What benign text makes, joined without space: words; numbers; numbers each after the word before it. Without base spans and candidate runs."""
    outside, at = [], 0
    long = [m.span() for m in _LONG.finditer(s) if m.end() - m.start() >= min_len]
    for a, e in sorted([*long, *((a, e) for a, _, e in base)]):
        if a > at:
            outside.append(s[at:a])
        at = max(at, e)
    tokens = _TOKENS.findall(" ".join([*outside, s[at:]]))
    numbers = [i for i, t in enumerate(tokens) if t[0] <= "9"]
    after = [i for i in numbers if i and tokens[i - 1][0] > "9"]
    return ["".join(t for t in tokens if t[0] > "9"), "".join(tokens[i] for i in numbers), "".join(tokens[i - 1] + tokens[i] for i in after)]


def decoy_stretches(joined: str, min_len: int = 20) -> Iterator[str]:
    """joined, cut into stretches: the length classes in turn, and each length of a class in turn."""
    ranges = [(max(a, min_len), b) for a, b in zip(LENGTHS, (*LENGTHS[1:], LONGEST_DECOY), strict=True) if b > min_len]
    at, i = 0, zlib.crc32(joined.encode())  # texts start at different places, as short ones have few
    while len(joined) - at >= min_len:
        low, high = ranges[i % len(ranges)]
        yield joined[at : (at := at + low + i // len(ranges) % (high - low))]
        i += 1


class _Decoys:
    """Counts of decoys by class and bin."""

    def __init__(self) -> None:
        self.cells = np.zeros(CLASSES * BINS, np.int64)
        self.waiting: dict[int, list[str]] = {}
        self.held = 0

    def add(self, s: str, base: list[tuple[int, int, int]], min_len: int) -> None:
        for joined in decoy_sources(s, base, min_len):
            for x in decoy_stretches(joined, min_len):
                self.waiting.setdefault(len(x), []).append(x)
                self.held += 1
        if self.held > DECOYS_AT_ONCE:
            self.score()

    def score(self) -> None:
        for strings in self.waiting.values():
            p = batteries(strings)
            # As score_bin() does, for all at once.
            bins = np.clip(((12 + np.log10(np.maximum(p, 1e-12))) / 12 * BINS).astype(int), 0, BINS - 1)
            np.add.at(self.cells, np.fromiter(map(class_of, strings), np.int64, len(strings)) * BINS + bins, 1)
        self.waiting, self.held = {}, 0

    def taken(self) -> list[dict]:
        self.score()
        out = [{"cell": int(c), "n": int(self.cells[c])} for c in np.flatnonzero(self.cells)]
        self.cells[:] = 0
        return out


def scan(docs: DataFrame, *, text: str = "text", min_len: int = 20, least_bin: int = LEAST_BIN) -> DataFrame:
    """docs with base: array<struct<start, kind, end>>, more: the same with the battery's class and bin, and decoys: array<struct<cell, n>>.

    A cell is class * BINS + bin; the decoys of a batch of rows are counted on its first row, and null on the others.
    """
    kind = "array<struct<start:int,kind:int,end:int>>"

    @F.arrow_udf(f"struct<base:{kind},more:array<struct<start:int,end:int,cls:int,bin:int>>,decoys:array<struct<cell:int,n:long>>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        i32 = lambda *names: pa.list_(pa.struct([(n, pa.int32()) for n in names]))
        shape = pa.struct([("base", i32("start", "kind", "end")), ("more", i32("start", "end", "cls", "bin")), ("decoys", pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())])))])
        decoys = _Decoys()
        for batch in batches:
            out = []
            for value in batch:
                s = value.as_py() or ""
                base = base_spans(s)
                more = [{"start": a, "end": e, "cls": class_of(s[a:e]), "bin": b} for a, e, b in candidates(s, base, min_len, least_bin)]
                decoys.add(s, base, min_len)
                out.append({"base": [{"start": a, "kind": k, "end": e} for a, k, e in base], "more": more, "decoys": None})
            if out:
                out[0]["decoys"] = decoys.taken()
            yield pa.array(out, shape)

    return docs.withColumn("_found", scanned(F.col(text))).select(*docs.columns, "_found.*")


def cutoffs(found: DataFrame, *, fdr: float = 0.05, least_bin: int = LEAST_BIN) -> list[int]:
    """For each class the lowest bin that is reported: decoys in it and above are at most fdr of candidates, were all of them benign."""
    one = F.lit(1).cast("long")
    real = found.select(F.explode("more").alias("x")).select((F.col("x.cls") * BINS + F.col("x.bin")).alias("cell"), F.lit(0).alias("decoy"), one.alias("n"))
    decoy = found.select(F.explode("decoys").alias("x")).select("x.cell", F.lit(1).alias("decoy"), "x.n")
    cells = {(r["decoy"], r["cell"]): r["n"] for r in real.unionByName(decoy).groupBy("decoy", "cell").agg(F.sum("n").alias("n")).collect()}
    return least_bins(cells, fdr, least_bin)


def least_bins(cells: dict[tuple[int, int], int], fdr: float, least_bin: int) -> list[int]:
    """From counts by (decoy, class * BINS + bin)."""
    counts = np.zeros((2, 3, len(LENGTHS), BINS))
    for (decoy, cell), n in cells.items():
        counts[decoy].reshape(-1)[cell] = n
    out = []
    for of in range(3):
        for length in range(len(LENGTHS)):
            real = counts[0, of, length]
            decoys = next((d for d in (counts[1, of, length], counts[1, of].sum(axis=0), counts[1].sum(axis=(0, 1))) if d.any()), None)
            best = BINS
            if decoys is not None and real.any():
                passing, false = np.cumsum(real[::-1])[::-1], np.cumsum(decoys[::-1])[::-1] * real.sum() / decoys.sum()
                good = [b for b in range(least_bin, BINS) if passing[b] and false[b] <= fdr * passing[b]]
                best = min(good, default=BINS)
            out.append(best)
    return out


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def find_secrets(docs: DataFrame, *, text: str = "text", fdr: float = 0.05, min_len: int = 20, least_bin: int = LEAST_BIN) -> DataFrame:
    """docs (without the text) with base and all spans as arrays of (start, kind, end), sorted. min_len is 16 or more."""
    kept = [c for c in docs.columns if c not in (text, "base", "more", "decoys", "all_spans")]
    found = saved(scan(docs.select(*kept, whole(F.col(text)).alias(text)), text=text, min_len=min_len, least_bin=least_bin).drop(text), "secrets")
    least = F.array(*[F.lit(b) for b in cutoffs(found, fdr=fdr, least_bin=least_bin)])
    reported = F.transform(F.filter("more", lambda x: x["bin"] >= F.element_at(least, x["cls"] + 1)), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))
    return found.select(*kept, "base", F.array_sort(F.concat("base", reported)).alias("all_spans"))
