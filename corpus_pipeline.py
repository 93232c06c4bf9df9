"""A training corpus from ``documents``: five stages, each written as Parquet and reread as the next one's input.

Each stage works on all rows that its predecessor kept and returns the columns of ``documents`` (the last: packed pieces).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.llm import decontam, langid, linededup, ngram_join, packing
from caseloom.llm.common import among, documents, saved, scratch_root
from caseloom.llm.queries import tokenizer_file
from caseloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in no language go; lang stays as it is, since it is the label."""
    ship(spark)
    return langid.identify(docs.select(*COLUMNS)).filter(~langid.rejects()).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; every row stays."""
    ship(spark)
    found = linededup.drop_boilerplate(docs.select(*COLUMNS), host="source")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, on one row; texts without words have no duplicates.

    Of rows that repeat that id the one with the first text stays. Rows without an id stay.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = saved(ngram_join.near_duplicates(docs).select("id", "class_id"), "near")
    # Ids that go, and ids that stay on one of several rows. A table of bits, of one size for any input, sorts out the texts that are
    # none of these where they lie; only the others, and the few that share a bit with them, are joined.
    goes = found.filter("id <> class_id").select(F.col("id").alias("doc_id")).distinct()
    several = found.filter("id = class_id").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("_rows")).filter("_rows > 1").select("doc_id")
    maybe = among(spark, goes.unionByName(several), "doc_id")
    sure, rest = docs.filter(~maybe), docs.filter(maybe).join(goes, "doc_id", "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text"), "lang", "source", "n_chars")
    once = rest.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return sure.unionByName(once.select(*COLUMNS)).select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    ship(spark)
    return decontam.hits(docs.select(*COLUMNS), documents(spark, sf_dir, "benchmark")).filter(~decontam.contaminated()).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    ship(spark)
    cut = packing.pieces(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near),
    ("decontamination", benchmarks),
    ("best_fit_packing", packed),
]

#: SQL cannot express the language model, MinHash pruning or local search; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
