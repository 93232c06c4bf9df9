"""Inputs that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows() -> list[tuple]:
    a, b = words(1, 120), words(2, 90)
    near = a.split()
    near[60] = "changed"
    return [
        (0, a, "en", "s0", None), (1, " ".join(near), "en", "s0", 1), (2, a, "en", "s1", 1), (3, b, "fr", None, 1), (4, None, "fr", "s1", None), (5, "", "en", "s1", 0), (6, "  \n\t ", None, "s0", 5),
        (7, "one two", "en", "s0", 7), (8, "one two", "en", "s0", 7), (8, "one two", "en", "s0", 7), (9, words(3, 6000), "en", "s0", 1), (10, "x" * 5000, "en", "s0", 5000), (11, "éàü — ñ 12.3 !?\n\nß z", "de", "s2", 1),
        (12, words(4, 40) + " " + " ".join(a.split()[10:80]) + " " + words(5, 40), "en", "s2", 1), (13, "!!! ... 123", "en", "s2", 1), (14, b.upper(), "fr", "s2", 1), (15, "one", "en", "s1", 3), (16, "a " * 200, "en", "s1", 400),
    ]


def documents(spark, extra: bool = True):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id")
    if extra:
        # Columns named like those the operators make.
        for name in ("score", "n_words", "items", "length", "piece", "base", "row", "id", "n_lines", "fingerprint", "n_tokens", "part"):
            df = df.withColumn(name, df["n_chars"])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df) -> dict:
    return {r["doc_id"]: r.asDict() for r in df.collect()}
