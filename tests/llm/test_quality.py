"""Positive-unlabelled quality scores: held-out accuracy, the risk against a plain version, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import quality
from caseloom.llm.queries import op12_quality

from .cases import documents, empty, rows


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = op12_quality(spark, sf_dir)
    got = found.join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    assert found.count() == 1000 and np.mean([r["quality"] == r["predicted"] for r in got]) > 0.95
    assert np.mean([r["predicted"] for r in got if r["quality"] == 1]) > 0.98
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_held_out_labels_and_texts_are_not_learnt_from(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    out = quality.held_out(F.col("doc_id"))
    weights = lambda d, x: quality.fit(d.filter(~quality.held_out(F.col("doc_id"))), x, steps=3)
    other = docs.withColumn("text", F.when(out, "changed").otherwise(F.col("text"))), labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(weights(docs, labels), weights(*other), atol=1e-9)


def test_risk_and_gradient_equal_a_plain_version(spark):
    texts = [("good words here", True, True), ("BAD!! BAD!!", False, True), ("fine lines\nof text", True, False), ("", False, True)]
    df = spark.createDataFrame(texts, "text string, positive boolean, unlabelled boolean").repartition(2)
    blocks = quality.saved(quality._blocks(df, "text", docs_at_once=2), "test")
    known, x = quality.Known(), np.zeros((4, quality.SIZE))
    for i, (t, *_) in enumerate(texts):
        places, values = quality.features(t, known)
        x[i, places] = values.astype(np.float32)
    w = np.random.default_rng(1).normal(size=quality.SIZE)
    g, p, u = x @ w, np.array([1, 0, 1, 0]), np.array([1, 1, 0, 1])
    prob, loss = 1 / (1 + np.exp(-g)), np.log1p(np.exp(g))
    got = quality._sums(blocks, w, 2)
    for row, by, total in zip(got, (p, prob * p, prob * u), (0, loss @ p, loss @ u), strict=True):
        assert np.allclose(row[:-1], by @ x) and np.isclose(row[-1], total)
    assert quality._histograms(blocks, w, 2).sum(axis=1).tolist() == [2, 3]


def test_step_goes_against_a_negative_risk(monkeypatch):
    seen = []

    def sums(blocks, w, many):
        seen.append(w.copy())
        out = np.zeros((3, quality.SIZE + 1))
        out[1, -1], out[2, -1], out[2, 0] = 10.0, 1.0, 1.0  # the estimated risk on negatives is below zero
        return out

    monkeypatch.setattr(quality, "_sums", sums)
    w = quality._descend(None, 0.5, 1, 1, steps=2, rate=0.1, ridge=0.0, many=1)
    assert w[0] > 0 and not w[1:].any()


def test_intercept_gives_the_prior():
    counts = np.zeros(quality._BINS)
    counts[[900, 1000, 1200]] = 5, 3, 2
    centre = (np.arange(quality._BINS) + 0.5) * 128 / quality._BINS - 64
    b = quality._intercept(counts, 0.4)
    assert abs((counts / (1 + np.exp(-centre - b))).sum() / 10 - 0.4) < 1e-6


def test_prior_without_negatives():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(8, 1, 40_000), rng.normal(-8, 1, 12_000)
    count = lambda x: np.histogram(x, quality._BINS, (-64, 64))[0].astype(float)
    assert abs(quality.bounded_prior(count(good[:10_000]), count(np.concatenate([good[10_000:38_000], bad]))) - 0.7) < 0.05


def test_only_positives_are_labelled(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    found = quality.classify(docs, labels.filter("quality = 1"), steps=5)
    assert found.filter("score between 0 and 1").count() == docs.count()


@pytest.mark.parametrize("text", ["a b a", "A!! B!!\nA!! B!!\n\n", "x" * 200_000, "é" * 70 + " 12:30 | ", "  \x1c"])
def test_features_are_bounded(text):
    places, values = quality.features(text, quality.Known())
    assert len(places) == len(set(places.tolist())) and places.max() == quality.SIZE - 1 and ((values > 0) & (values <= 1)).all()


def test_full_table_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(quality, "CACHE_WORDS", 8)
    known = quality.Known()
    for text in ("a b c d e f g h i j k l m", "c b a", "n o p q r s t u v w x y z n o"):
        got, want = quality.features(text, known), quality.features(text, quality.Known())
        assert np.array_equal(got[0], want[0]) and np.allclose(got[1], want[1])


def test_quality_on_odd_rows(spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(12)] + [(3, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    got = quality.classify(documents(spark), labels, steps=3).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[4] == by[5]
    assert quality.classify(empty(spark), labels).count() == 0
    assert {r["score"] for r in quality.classify(documents(spark), labels.filter("quality = 0")).collect()} == {0.5}
    keyless = documents(spark).withColumn("doc_id", F.lit(None).cast("long"))
    assert {r["held_out"] for r in quality.classify(keyless, labels).collect()} == {True}
