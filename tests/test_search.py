"""Keyword search, nearest neighbours and their composition against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest

from caseloom.operators import keyword, pivots, vector
from caseloom.plans import pipelines
from caseloom.sources import fixtures

SEARCHED = "ordinal long, title string, snippet string, year int"


def _plain_keyword(rows, query, limit):
    q = (query or "").lower()
    rows = sorted(rows)
    hits = [r for r in rows if q in (r[1] or "").lower() or q in (r[2] or "").lower()]
    return [r[0] for r in (hits or rows)[:limit]]


@pytest.mark.parametrize("first_rows", [1, 5, 10_000])
def test_keyword_search_equals_a_plain_version(spark, first_rows):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("aAbB cé\U0001f600") for _ in range(n))
    rows = [(i * 3, rng.choice([None, "", text(4)]), rng.choice([None, "", text(rng.randrange(40))]), i) for i in range(60)]
    asked = [(i, rng.choice([None, "", "a", "zzz", "\U0001f600", "AB", "c ", text(rng.randrange(1, 6))])) for i in range(120)] + [(None, "a"), (7, "b")]
    df, queries = spark.createDataFrame(rows, SEARCHED).repartition(4), spark.createDataFrame(asked, "query_id long, query string").repartition(3)
    found = fixtures.keyword_search(df, queries, limit=4, first_rows=first_rows).collect()
    want = sorted((str(k), n, o) for k, q in asked for n, o in enumerate(_plain_keyword(rows, q, 4), 1))
    assert sorted((str(r["query_id"]), r["rank"], r["ordinal"]) for r in found) == want
    assert all(r["year"] * 3 == r["ordinal"] for r in found)


def test_keyword_search_without_rows_or_queries(spark):
    rows, queries = spark.createDataFrame([], SEARCHED), spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert fixtures.keyword_search(rows, queries).count() == 0
    assert fixtures.keyword_search(spark.createDataFrame([(1, "a", "b", 2)], SEARCHED), queries.limit(0)).count() == 0


def test_a_query_in_every_row_meets_the_first_rows_only(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "all", f"number {i}", 0) for i in range(500)], SEARCHED)
    seen = []
    matches = keyword._matches
    monkeypatch.setattr(keyword, "_matches", lambda rows, asked, *rest: seen.append((rows.count(), asked.count())) or matches(rows, asked, *rest))
    got = keyword.first_matches(rows, spark.createDataFrame([("all",), ("number 499",), ("none at all",)], "query string"), limit=3, first_rows=20).collect()
    assert seen == [(20, 3), (480, 2)]
    assert {(r["query"], r["ordinal"]) for r in got} == {*(("all", i) for i in range(3)), *(("none at all", i) for i in range(3)), ("number 499", 499)}


def test_grams_of_any_length():
    assert len(keyword.grams("", (1, 2, 3))) == 0
    assert len(keyword.grams("abcab", (3,))) == 3 and len(keyword.grams("aaaa", (1, 2, 3))) == 3
    assert not set(keyword.grams("a", (1,)).tolist()) & set(keyword.grams("ab", (2,)).tolist())


def test_queries_of_any_length_write_only_what_they_match(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abé\U0001f600 ") for _ in range(n))
    rows = [(i, text(3), text(rng.randrange(120)), 0) for i in range(300)]
    cut = lambda s, n: s[(a := rng.randrange(max(1, len(s) - n))) : a + n]
    asked = [(i, cut(rows[i][2], rng.randrange(1, 60)) + rng.choice(["", "", "zz"])) for i in range(300)]
    written = []
    kept = keyword.stored
    monkeypatch.setattr(keyword, "stored", lambda df, name: written.append((name, df.columns, (out := kept(df, name)).count())) or out)
    monkeypatch.setattr(keyword, "GROUP", 500)
    df, queries = spark.createDataFrame(rows, SEARCHED).repartition(4), spark.createDataFrame(asked, "query_id long, query string")
    found = fixtures.keyword_search(df, queries, limit=3, first_rows=2).collect()
    assert sorted((r["query_id"], r["rank"], r["ordinal"]) for r in found) == sorted((k, n, o) for k, q in asked for n, o in enumerate(_plain_keyword(rows, q, 3), 1))
    # No text of a row is written, and no more matches than asked for in each range of rows.
    assert {name for name, *_ in written} == {"queries", "matches"} and all("snippet" not in columns for _, columns, _ in written)
    assert sum(n for name, _, n in written if name == "matches") <= 3 * sum(1 for name, *_ in written if name == "matches") * len({q for _, q in asked})


def _vectors(spark, rows, key="vec_id"):
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


def _plain_nearest(rows, asked, k):
    usable = lambda v: v and all(x is not None and np.isfinite(x) for x in v)
    out = set()
    for q, a in asked:
        if usable(a):
            near = sorted((sum((float(np.float32(x)) - float(np.float32(y))) ** 2 for x, y in zip(a, v, strict=True)), i) for i, v in rows if usable(v) and len(v) == len(a))
            out |= {(q, n, i) for n, (_, i) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("sent_mb", [64, 0])
def test_nearest_with_nulls_ties_and_dimensions(spark, sent_mb):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4 if i % 4 else 2)]) for i in range(90)]
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0] * 3), (106, [0.0] * 4)]
    asked = [*rows[:90:5], *rows[90:], (200, [1.0] * 9)]
    got = vector.nearest(_vectors(spark, asked, "query_id").repartition(3), _vectors(spark, rows).repartition(4), 6, max_broadcast_mb=sent_mb, block=8, pivots=5)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()} == _plain_nearest(rows, asked, 6)


def test_no_sound_vector_at_all(spark):
    none = _vectors(spark, [(1, None)])
    for mb in (64, 0):
        assert vector.nearest(none.withColumnRenamed("vec_id", "query_id"), none, 3, max_broadcast_mb=mb).count() == 0
        assert vector.nearest(_vectors(spark, [(1, [1.0])], "query_id"), none, 3, max_broadcast_mb=mb).count() == 0


def test_pivots_skip_cells_and_stay_exact(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 20
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=16))]) for i in range(600)] + [(1000 + i, [5.0] * 16) for i in range(300)]
    index = pivots.PivotIndex(_vectors(spark, rows).toDF("id", "v").repartition(3), pivots=16, block=8)
    asked = [*rows[:60], (5000, [5.0] * 16), (5001, [0.0] * 16)]
    found = index.search(_vectors(spark, asked, "query_id").toDF("id", "v"), 4, vector._least).collect()
    best = {}
    for r in found:
        best.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    got = {(q, n, i) for q, near in best.items() for n, (_, i) in enumerate(sorted(near)[:4], 1)}
    assert got == _plain_nearest(rows, asked, 4)
    assert index.visited < index.cells_by_queries / 3


def test_a_search_by_pivots_writes_each_vector_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    written = []
    kept = pivots.stored
    monkeypatch.setattr(pivots, "stored", lambda df, name: written.append((name, (out := kept(df, name)).count(), "v" in df.columns)) or out)
    got = vector.nearest(_vectors(spark, rows, "query_id"), _vectors(spark, rows), 3, max_broadcast_mb=0, block=4, pivots=12).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == _plain_nearest(rows, rows, 3)
    assert all(n <= 400 for _, n, vectors in written if vectors)
    # Cells after the first give only what lies within the limit found there.
    assert sum(n for name, n, _ in written if name == "found") < 400 * 3 * 12


def test_hits_are_worked_out_once_for_their_supplement(spark, monkeypatch):
    stored = []
    kept = vector.stored
    monkeypatch.setattr(vector, "stored", lambda df, name: stored.append(name) or kept(df, name))
    hits = spark.createDataFrame([(1, "a", 1, 0.5)], "query_id long, doc_id string, rank int, similarity double")
    more = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id long, ordinal int, doc_id string")
    assert {(r["doc_id"], r["rank"]) for r in vector.supplement(hits, more, 3).collect()} == {("a", 1), ("b", 5)}
    assert stored == ["hits"]


def test_same_vectors_are_searched_once_and_keywords_only_for_places_left(spark, monkeypatch):
    seen, asked_for = [], []
    nearest = pipelines.nearest
    monkeypatch.setattr(pipelines, "nearest", lambda queries, *rest: seen.append(queries.count()) or nearest(queries, *rest))

    def keyword(questions):
        asked_for.extend(r["query"] for r in questions.collect())
        return questions.selectExpr("query_id", "0 as ordinal", "'30' as doc_id")

    asked = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, "a"), (4, "xa")], "query_id long, query string")
    found = pipelines.search(asked, _toy_index(spark), 3, keyword=keyword, encoder=_toy).collect()
    assert seen == [2] and len(asked_for) > 0
    of = lambda q: sorted((r["rank"], r["doc_id"]) for r in found if r["query_id"] == q)
    assert of(1) == of(2) and of(3) == of(4)
    asked_for.clear()
    full = pipelines.search(asked, _toy_index(spark).filter("vec_id > 1"), 3, keyword=keyword, encoder=_toy)
    assert asked_for == [] and full.filter("source = 'keyword'").count() == 0


def _toy(texts):
    """Two features: how many a and b a text has."""
    return np.array([[t.count("a"), t.count("b")] for t in texts], np.float32)


def _toy_index(spark):
    rows = [(1, 10, [1.0, 0.0]), (2, 10, [1.0, 0.0]), (3, 11, [0.0, 1.0]), (4, 12, [float(np.float32(0.6)), float(np.float32(0.8))])]
    return spark.createDataFrame(rows, "vec_id long, doc_id long, embedding array<float>")


KEYWORD_ROWS = [(0, "10", "a first", ""), (1, "21", "has aa too", None), (2, "22", "b", "x"), (3, "23", None, "other")]


def test_search_with_its_supplement(spark):
    keyword_rows = spark.createDataFrame(KEYWORD_ROWS, "ordinal int, doc_id string, title string, snippet string")
    asked = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, "zz b")], "query_id long, query string")
    found = pipelines.search(asked, _toy_index(spark), 3, keyword=keyword_rows, encoder=_toy).collect()
    got = {q: [(r["doc_id"], r["source"], r["similarity"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3, 4)}
    # The three nearest chunks of aa are of documents 10, 10 and 12; one place is left, for the only title with aa.
    assert got[1] == got[2] == [("10", "vector", 1.0), ("12", "vector", round(1 / 1.8, 6)), ("21", "keyword", 0.0)]
    # The empty question is as far from all; its place goes to the first row, which is there already.
    assert got[3] == [("10", "vector", 0.5), ("11", "vector", 0.5)]
    # Nothing has "zz b", so all rows count, of which the first is document 10.
    assert [x[:2] for x in got[4]] == [("11", "vector"), ("12", "vector"), ("10", "vector")]


def test_search_without_an_index_or_keywords(spark):
    asked = spark.createDataFrame([(1, "aa")], "query_id long, query string")
    keyword_rows = spark.createDataFrame(KEYWORD_ROWS, "ordinal int, doc_id string, title string, snippet string")
    empty = _toy_index(spark).filter("false")
    assert [(r["doc_id"], r["rank"], r["similarity"]) for r in pipelines.search(asked, empty, 3, keyword=keyword_rows, encoder=_toy).collect()] == [("21", 4, 0.0)]
    assert pipelines.search(asked, empty, 3, encoder=_toy).count() == 0


def test_failing_keyword_search_is_left_out(spark):
    asked = spark.createDataFrame([(1, "aa")], "query_id long, query string")

    def fails(questions):
        raise OSError("no network")

    with pytest.warns(UserWarning, match="no network"):
        assert {r["source"] for r in pipelines.search(asked, _toy_index(spark), 3, keyword=fails, encoder=_toy).collect()} == {"vector"}

    def partly(questions):
        return questions.selectExpr("query_id", "explode(array(struct(0 as ordinal, '30' as doc_id, 502 as status), struct(1 as ordinal, '31' as doc_id, 200 as status))) as r").select("query_id", "r.*")

    assert [r["doc_id"] for r in pipelines.search(asked, _toy_index(spark), 3, keyword=partly, encoder=_toy).orderBy("rank").collect()] == ["10", "12", "31"]


def test_sparse_queries_are_sent_by_their_places(spark, monkeypatch):
    """More queries than the bound holds as dense vectors, few of whose places are not zero: no query is copied to cells."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 1024).astype(float).tolist()) for i in range(60)] + [(60, [0.0] * 1024), (61, [1e25] * 1024)]
    asked = []
    for i in range(300):
        v = np.zeros(1024)
        v[:9], v[rng.integers(9, 1024, i % 3)] = i % 5, 1.0
        asked.append((i, v.tolist()))
    monkeypatch.setattr(vector, "PivotIndex", None)
    got = vector.nearest(_vectors(spark, asked, "query_id").repartition(3), _vectors(spark, rows).repartition(2), 4, max_broadcast_mb=1, block=8).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == _plain_nearest(rows, asked, 4)


@pytest.mark.parametrize("scale", [1.0, 1e-30, 3e18, 1e30])
def test_least_rows_of_any_size(scale):
    rng = np.random.default_rng(6)
    x, q = (rng.integers(-3, 4, (n, 12)).astype(np.float32) * np.float32(scale) for n in (90, 25))
    q[:, 4:] *= rng.random((25, 8)) < 0.1
    got = vector._least(np.arange(25), q, iter([pd.DataFrame({"id": np.arange(90)[i : i + 30], "v": list(x[i : i + 30])}) for i in (0, 30, 60)]), 5, 8)
    d = ((q[:, None].astype(np.float64) - x[None]) ** 2).cumsum(axis=2)[:, :, -1]
    want = {(i, int(j)) for i in range(25) for j in np.lexsort((np.arange(90), d[i]))[:5]}
    assert set(zip(got["query_id"], got["vec_id"], strict=True)) == want
