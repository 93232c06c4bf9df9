"""The registered queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, langid, linededup, merkle, ngram_join, oracles, packing, periodic, quality, secrets, substring_index, tokencount, warc
from .common import documents, sha


def tokenizer_file(name: str) -> str:
    """A vocabulary file; its folder is a parameter."""
    if folder := os.environ.get("CASELOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", tokencount.n_bytes(F.col("text")).alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "n_links", "text_id", "n_texts")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(documents(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return found.select("record_id", "canonical_url", "status", "response_id", "payload_digest", F.array_join(lines, "\n").alias("merged_headers"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.compare_with_next(documents(spark, sf_dir).select("doc_id", "text"))
    place = lambda e: F.concat_ws(".", e["section"].cast("string"), e["paragraph"].cast("string"))
    edits = F.array_join(F.transform("edits", place), ",")
    return found.select("doc_id", "n_chars", sha(F.col("edited_text")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", edits.alias("edits"), "near_edited", "near_next")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), sha(secrets.joined(F.col("base"))).alias("base_sha256"), secrets.joined(F.col("all_spans")).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha(F.array_join("items", ",")).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def _made_periodic(text: Column, key: Column) -> Column:
    """The contract's stretch of repeated words, in texts whose key's crc32 ends in 0."""
    h = F.crc32(key.cast("string"))
    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), 1)
    n = F.size(words).cast("long")
    g = F.floor(h / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", _made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.find_runs(docs).withColumn("top", periodic.longest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        sha(periodic.listed(F.col("runs"))).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir).select("text", "lang", "source"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_dropped", sha(F.col("text")).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_token_counts, op3_ngram_jaccard_join, op4_warc_revisits, op5_document_fingerprints, op6_substring_dedup, op7_best_fit_packing, op8_secret_scans, op9_decontamination, op10_line_dedup, op11_periodic_runs, op12_quality, op13_source_divergence)
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
#: Not here: op1 (a fitted model), op2 and op7 (a tokenizer), op8 (tests of randomness), op12 (a fitted model), pipeline (all of these).
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op4_warc_revisits": oracles.WARC,
    "op5_document_fingerprints": oracles.FINGERPRINTS,
    "op6_substring_dedup": oracles.SUBSTRINGS,
    "op9_decontamination": oracles.DECONTAMINATION,
    "op10_line_dedup": oracles.LINES,
    "op11_periodic_runs": oracles.PERIODIC,
    "op13_source_divergence": oracles.DIVERGENCE,
}
