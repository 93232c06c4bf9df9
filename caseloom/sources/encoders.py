"""Encoders for text (SRC-9) and clients for models (SRC-10) behind one retry policy."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class HashingEncoder:
    """A deterministic stand-in for a text model: hashed counts of words, at unit length. Not equal to any model's vectors."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [text.lower().split() for text in texts]
        distinct = {w: i for i, w in enumerate({w for ws in words for w in ws})}
        h = np.fromiter((zlib.crc32(w.encode()) for w in distinct), np.int64, len(distinct))
        each = np.fromiter((distinct[w] for ws in words for w in ws), np.int64)
        rows = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        sums = np.bincount(rows * self.dimension + (h % self.dimension)[each], np.where(h[each] >> 31, 1.0, -1.0), len(texts) * self.dimension)
        out = sums.reshape(len(texts), self.dimension).astype(np.float32)
        norm = np.sqrt((sums.reshape(out.shape) ** 2).sum(axis=1, keepdims=True)).astype(np.float32)
        return np.divide(out, norm, out=out, where=norm > 0)


class ModelLoading(RuntimeError):
    """The service has not loaded its model yet."""


class ServiceError(RuntimeError):
    """An answer that a further attempt does not mend."""


def with_retries(call: Callable[[], tuple[int, object, float]], *, attempts: int = 3, waits: tuple[float, ...] = (2.0, 4.0, 8.0), wait_while_loading: bool = True, sleep: Callable[[float], None] = time.sleep) -> object:
    """call gives (status, body, retry_after). 200: the body. 503: waits as told, or ModelLoading at once. 429 and network errors: backs off. Else ServiceError."""
    loading = False
    for attempt in range(attempts):
        try:
            status, body, retry_after = call()
        except OSError as error:
            body, loading = error, False
            sleep(waits[min(attempt, len(waits) - 1)])
            continue
        if status == 200:
            return body
        if status == 503:
            if not wait_while_loading:
                raise ModelLoading(str(body))
            loading = True
            sleep(retry_after)
        elif status == 429:
            loading = False
            sleep(waits[min(attempt, len(waits) - 1)])
        else:
            raise ServiceError(f"{status}: {body}")
    raise (ModelLoading if loading else ServiceError)(f"no answer after {attempts} attempts: {body}")


def entities(cases: DataFrame, client: Callable[[str], list[dict]], *, key: str = "case_id", text: str = "case_text") -> DataFrame:
    """SRC-10: (key, pos, entity_group, word, score) from a model client called on each text, in the tasks."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, str(e.get("entity_group", e.get("entity", ""))), str(e.get("word", "")).strip(), float(e.get("score", 0.0))) for k, t in zip(frame[key], frame[text], strict=True) for i, e in enumerate(client(t or "") or []) if isinstance(e, dict)]
            yield pd.DataFrame(rows, columns=[key, "pos", "entity_group", "word", "score"])

    kind = cases.schema[key].dataType.simpleString()
    return cases.select(key, text).mapInPandas(found, f"{key} {kind}, pos int, entity_group string, word string, score double")
