"""Each stage of the pipeline on its own input against a plain version."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import tokencount
from caseloom.llm.queries import tokenizer_file

from .cases import documents, empty, rows
from .test_operators import _links


def test_stages_keep_the_columns(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (documents(spark, extra=False), empty(spark)):
            got = stage(spark, docs, sf_dir)
            assert tuple(got.columns) == corpus_pipeline.COLUMNS, name
            assert got.count() <= docs.count()


def test_language_stage_drops_only_what_has_no_language(spark, sf_dir):
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, documents(spark), sf_dir).collect()}
    assert got == {r[0] for r in rows() if any(c.isalpha() for c in r[1] or "")}


def test_near_stage_keeps_one_of_each_group(spark, sf_dir):
    docs = documents(spark, extra=False)
    links = _links({r[0]: r[1] for r in rows()})
    got = sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, sf_dir).collect())
    assert got == sorted(i for i, x in links.items() if not x or i < min(x))
    nulls = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.near(spark, docs.unionByName(nulls), sf_dir).count() == len(got) + 3


def test_line_stage_against_a_plain_version(spark, sf_dir):
    pages = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    pages += [(10_000 + i, "s", f"menu\nown {i}\n home ") for i in range(8)] + [(20_000, None, None)]
    total, seen = Counter(s for _, s, _ in pages), Counter()
    lines = lambda t: t.split("\n") if t else []
    for _, source, text in pages:
        seen.update({(source, x.strip(" \t\r")) for x in lines(text)})
    goes = lambda s, x: x != "" and seen[s, x] >= 5 and seen[s, x] > 0.1 * total[s]
    want = {k: "\n".join(x for x in lines(t) if not goes(s, x.strip(" \t\r"))) for k, s, t in pages}
    df = spark.createDataFrame([(k, t, "en", s, 0) for k, s, t in pages], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.lines(spark, df, sf_dir).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_last_stage_on_an_empty_table(spark, sf_dir):
    assert corpus_pipeline.packed(spark, empty(spark), sf_dir).count() == 0


def test_benchmark_stage_against_a_plain_version(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in bench.collect():
        w = fold(r["text"])
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    sizes = {len(w) for w in windows}

    def stays(text):
        w, hit = fold(text), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        return not (hit and 20 * len(hit) >= len(w))

    want = sorted(r["doc_id"] for r in docs.collect() if stays(r["text"]))
    assert sorted(r["doc_id"] for r in corpus_pipeline.benchmarks(spark, docs, sf_dir).collect()) == want and len(want) < docs.count()


def test_packing_stage_against_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoder = tokencount.tokenizer(tokenizer_file("word_bpe_49k.json"))
    got = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]): (r["sequence_id"], r["offset"]) for r in corpus_pipeline.packed(spark, docs, sf_dir).collect()}
    want = set()
    for r in docs.collect():
        ids = np.array([*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(r["doc_id"], i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for i, at in enumerate(range(0, len(ids), 2048))}
    assert set(got) == want
    places = defaultdict(list)
    for (_, _, _, length, _), (sequence, offset) in got.items():
        places[sequence].append((offset, length))
    for held in places.values():
        ends = [0, *(a + n for a, n in sorted(held))]
        assert [a for a, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) <= -(-sum(k[3] for k in got) // 2048) * 1.02 + 1


def test_whole_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    fill = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert fill and all(r["n"] == r["end"] <= 2048 for r in fill)
