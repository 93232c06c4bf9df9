"""Sentence split and greedy word chunker (VEC-1 to VEC-3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, text_or

#: Texts that are held in words at once.
AT_ONCE = 256
_END = re.compile(r"(?<=[.!?])\s+")


def sentences(text: Column) -> Column:
    """VEC-1."""
    return F.filter(F.transform(F.split(strip(text_or(text)), r"(?U)(?<=[.!?])\s+", -1), strip), lambda s: s != "")


def chunk_spans(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """VEC-2 as spans over the words of a text, from the sizes of its sentences.

    A span closes where the next sentence would pass the target; the next one opens ``overlap`` words before that place. A
    sentence longer than the target is spans of its own, cut hard and without overlap.
    """
    spans: list[tuple[int, int]] = []
    low = at = 0
    for n in sizes:
        if n > target:
            spans += [(low, at)] * (low < at) + [(i, min(i + target, at + n)) for i in range(at, at + n, target)]
            low = at + n
        elif low < at and at - low + n > target:
            spans.append((low, at))
            low = max(low, at - overlap)
        at += n
    return spans + [(low, at)] * (low < at)


def chunk_words(text: str | None, target: int = 500, overlap: int = 50) -> list[str]:
    words = (text or "").split()
    sizes = [len(s.split()) for s in _END.split((text or "").strip())]
    return [" ".join(words[a:e]) for a, e in chunk_spans(sizes, target, overlap)]


def chunks(docs: DataFrame, *, text: str = "text", target: int = 500, overlap: int = 50) -> DataFrame:
    """VEC-3: docs (without the text) exploded to chunk_index (from 0), total_chunks and text. Null or blank -> no rows."""

    @F.arrow_udf("array<string>")
    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for i in range(0, len(batch), AT_ONCE):
                yield pa.array([chunk_words(x.as_py(), target, overlap) for x in batch.slice(i, AT_ONCE)], pa.list_(pa.string()))

    kept = [c for c in docs.columns if c not in (text, "chunk_index", "total_chunks", "_chunks")]
    parts = docs.select(*kept, cut(F.col(text)).alias("_chunks"))
    return parts.select(*kept, F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "text"))
