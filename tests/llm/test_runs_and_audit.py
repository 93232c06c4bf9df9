"""Periodic runs and the divergence audit against plain versions, and on the inputs of cases.py."""

import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caseloom.llm import divergence, periodic

from .cases import by_id, documents, empty, rows


def _plain_runs(w, least_words=6, least_exponent=4):
    """All stretches of equal words q apart, the least q of each."""
    found = {}
    for q in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(least_words, least_exponent * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _random_texts(n):
    rng = random.Random(11)
    for _ in range(n):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            p, a = rng.randrange(1, 6), rng.randrange(8)
            w = w[:a] + [(w + [0] * 99)[a + i % p] for i in range(rng.randrange(5, 50))] + w[a:]
        yield w


@pytest.mark.parametrize("least", [(6, 4), (3, 3), (20, 4), (1, 5)])
def test_runs_equal_brute_force(least):
    texts = list(_random_texts(700))
    assert periodic.runs_of(texts, least_words=least[0], least_exponent=least[1]) == [_plain_runs(w, *least) for w in texts]


def test_runs_of_colliding_keys(monkeypatch):
    monkeypatch.setattr(periodic, "_keys", lambda x, gram: x[: len(x) - gram + 1].astype("uint64") * 0)
    texts = list(_random_texts(100))
    assert periodic.runs_of(texts) == [_plain_runs(w) for w in texts]


@pytest.mark.parametrize("w", [[0] * 100_000, [i % 7 for i in range(100_000)], [i % 20_000 for i in range(100_000)], [j for i in range(20_000) for j in (100 + i, 1, 2, 3, 4, 5)]], ids=["one", "seven", "far", "many left words"])
def test_long_texts_take_near_linear_time(w):
    began = time.time()
    found = periodic.runs_of([w])[0]
    assert time.time() - began < 20
    assert found in ([(0, 100_000, 1)], [(0, 100_000, 7)], [(0, 100_000, 20_000)], [])


def test_runs_on_odd_rows(spark):
    got = by_id(periodic.find_runs(documents(spark)))
    assert len(got) == len({r[0] for r in rows()})
    for key, text, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert [tuple(r) for r in got[key]["runs"]] == _plain_runs(w)
        gone = {i for s, n, q in _plain_runs(w) for i in range(s + q, s + n)}
        assert got[key]["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic.find_runs(empty(spark)).count() == 0


def test_longest_run_and_list(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b a b x " + "c " * 10), (2, "no runs"), (3, None)], "doc_id long, text string")
    found = periodic.find_runs(df)
    got = by_id(found.select("doc_id", periodic.longest(found["runs"]).alias("top"), periodic.listed(found["runs"]).alias("listed")))
    assert tuple(got[1]["top"]) == (0, 10, 2) and got[1]["listed"] == "0,10,2\n11,10,1\n"
    assert got[2]["top"] is None and got[2]["listed"] == "" and got[3]["listed"] == ""


def _plain_audit(docs, least_docs, smooth, terms):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, holds, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.add((lang, source))
        n[lang, source].update(words)
        holds[lang].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [t for t, d in holds[lang].items() if d >= least_docs]
        of = {g: Counter({t: c for t, c in n[lang, g].items() if holds[lang][t] >= least_docs}) for a, g in groups if a == lang}
        every = sum(of.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + smooth) // (sum(c.values()) + smooth * len(kept))  # noqa: E731, B023
        pairs = [(-sum(abs(share(of[source], t) - share(of[g], t)) for t in kept), g.encode(), g) for g in of if g != source]
        own = [(share(every, t) - share(of[source], t), t.encode(), t) for t in kept if of[source][t] and share(of[source], t) > share(every, t)]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:terms])):
            out |= {(lang, source, part, item, -value, i) for i, (value, _, item) in enumerate(found, 1)}
    return out


def _audited(df, **kw):
    found = divergence.audit(df, **kw).collect()
    got = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found}
    assert len(got) == len(found)
    return got


@pytest.mark.parametrize("most", [100_000, 0], ids=["sent round", "joined"])
def test_audit_equals_a_plain_version(spark, sf_dir, most):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").limit(120)
    odd = [(None, None, None), ("Émile ÉMILE émile a1b", "fr", "quiet"), ("", "fr", "empty"), ("... 12", "xx", "no terms"), ("a", "xx", None), ("Ω ω \U0001f600 a", "fr", "z")]
    df = docs.unionByName(spark.createDataFrame(odd, "text string, lang string, source string")).withColumns({"term": F.lit("x"), "n": F.lit(1), "v": F.lit(1)})
    assert _audited(df, least_docs=4, smooth=5, terms=7, broadcast_groups=most) == _plain_audit([(r["text"], r["lang"], r["source"]) for r in df.collect()], 4, 5, 7)


def test_audit_without_kept_terms_and_without_rows(spark):
    df = spark.createDataFrame([("a b", "en", "s"), ("c", "en", "t")], "text string, lang string, source string")
    assert _audited(df) == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}
    assert _audited(empty(spark)) == set()


def test_tree_shares_paths():
    tree = divergence._Tree()
    for row in sorted([[(1, 5, 1), (2, 7, 1)], [(1, 5, 1), (2, 7, 1)], [(1, 5, 1), (3, 9, 1)], [(2, 7, 1)]]):
        tree.insert(row)
    assert len(tree.item) == 4 and sorted(tree.times) == [1, 1, 2, 3]


def test_counts_beyond_63_bits_of_product(spark):
    big = 9_007_199_254_740_993
    row = spark.createDataFrame([(big, big + 6, 12_345, 5)], "n long, t long, v long, smooth long")
    assert row.select(divergence._share("n", "t").alias("p")).first()["p"] == 1 + 10**9 * (big + 5) // (big + 6 + 5 * 12_345)
