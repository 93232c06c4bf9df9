"""Clients of model services, in the tasks (SRC-9, SRC-10): one retry policy, an outcome for every row, and a queue for models that load.

The transport is a parameter: ``post(url, headers, payload, timeout)`` gives (status, headers, body as bytes) or raises OSError where there is no
answer. A batch asks for each of its distinct texts once, ``parallel`` at a time.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .encoders import ModelLoading, ServiceError, with_retries

Post = Callable[[str, dict[str, str], dict, float], tuple[int, dict[str, str], bytes]]

#: Outcomes: the answer, a model that loads, a model that is not there, anything else that went wrong.
OK, LOADING, MISSING, FAILED = "ok", "loading", "missing", "failed"


def post_json(url: str, headers: dict[str, str], payload: dict, timeout: float) -> tuple[int, dict[str, str], bytes]:
    request = urllib.request.Request(url, json.dumps(payload).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as error:
        return error.code, dict(error.headers), error.read()


@dataclass(frozen=True)
class Service:
    """A service and how it is asked. ``loading_wait`` is the wait where a 503 does not tell one, times the attempt if ``loading_grows``."""

    url: str
    post: Post = post_json
    key: str = ""
    timeout: float = 30.0
    attempts: int = 3
    waits: tuple[float, ...] = (2.0, 4.0, 8.0)
    wait_while_loading: bool = True
    loading_wait: float = 2.0
    loading_grows: bool = True
    sleep: Callable[[float], None] = field(default=time.sleep)

    def headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json", "User-Agent": "Caseloom"}

    def ask(self, text: str) -> dict:
        """status, http (of the last answer, 0 without one), attempts, retry_after, error, body."""
        seen = {"http": 0, "attempts": 0, "retry_after": None}

        def call() -> tuple[int, object, float]:
            seen["attempts"] += 1
            seen["http"] = 0
            status, headers, body = self.post(self.url, self.headers(), {"inputs": text}, self.timeout)
            seen["http"] = status
            wait = self.loading_wait * (seen["attempts"] if self.loading_grows else 1)
            told = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
            try:
                wait = float(told) if told is not None else wait
            except ValueError:
                pass
            seen["retry_after"] = wait if status == 503 else None
            return status, body, wait

        try:
            body = json.loads(with_retries(call, attempts=self.attempts, waits=self.waits, wait_while_loading=self.wait_while_loading, sleep=self.sleep))
            return {**seen, "status": OK, "error": None, "body": body}
        except ModelLoading:
            return {**seen, "status": LOADING, "error": "the model is loading", "body": None}
        except ServiceError as error:
            return {**seen, "status": MISSING if seen["http"] == 404 else FAILED, "error": str(error), "body": None}
        except ValueError as error:
            return {**seen, "status": FAILED, "error": f"unreadable answer: {error}", "body": None}


def embedding_service(url: str, **options) -> Service:
    """SRC-9's policy: three attempts, 2 s doubled for 429 and network errors, and waits while the model loads."""
    return Service(url, **options)


def recogniser_service(url: str, **options) -> Service:
    """SRC-10's policy: as above, but a model that loads is told at once, with 20 s to wait unless the answer says otherwise."""
    return Service(url, **{"timeout": 45.0, "wait_while_loading": False, "loading_wait": 20.0, "loading_grows": False, **options})


def embedding_of(body: object) -> list[float] | None:
    """The first vector of a list of vectors, or of the list under ``embeddings``."""
    if isinstance(body, dict):
        body = body.get("embeddings")
    if isinstance(body, list) and body and isinstance(body[0], list):
        return [float(x) for x in body[0]]
    return None


_SAID = [("status", T.StringType()), ("http", T.IntegerType()), ("attempts", T.IntegerType()), ("retry_after", T.DoubleType()), ("error", T.StringType())]


def _asked(rows: DataFrame, service: Service, text: str, parallel: int, out: str, kind: T.DataType, read: Callable[[object], object], arrow: pa.DataType) -> DataFrame:
    """rows with out (what read makes of an answer; a null makes it a failure) and the outcome of each row."""
    kept = rows.drop(out, *[n for n, _ in _SAID])
    at = kept.columns.index(text)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                texts = [x or "" for x in batch.column(at).to_pylist()]
                distinct = list(dict.fromkeys(texts))
                answers = dict(zip(distinct, pool.map(service.ask, distinct), strict=True))
                for a in answers.values():
                    a["value"] = read(a["body"]) if a["status"] == OK else None
                    if a["status"] == OK and a["value"] is None:
                        a |= {"status": FAILED, "error": f"unexpected answer: {type(a['body']).__name__}"}
                found = [answers[t] for t in texts]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
                said = [pa.array([f[n] for f in found], k) for (n, _), k in zip(_SAID, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f["value"] for f in found], arrow), *said], [*batch.schema.names, out, *[n for n, _ in _SAID]])

    return kept.mapInArrow(answered, T.StructType([*kept.schema.fields, T.StructField(out, kind), *[T.StructField(n, t) for n, t in _SAID]]))


def embed(rows: DataFrame, service: Service, *, text: str = "text", out: str = "embedding", parallel: int = 4) -> DataFrame:
    """SRC-9: rows with the service's vector of each text (null where there is none), status, http, attempts, retry_after and error."""
    return _asked(rows, service, text, parallel, out, T.ArrayType(T.FloatType()), embedding_of, pa.list_(pa.float32()))


_ENTITY = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("entity_group", T.StringType()), T.StructField("word", T.StringType()), T.StructField("score", T.DoubleType())])
_ENTITY_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("entity_group", pa.string()), ("word", pa.string()), ("score", pa.float64())]))


def entities_of(body: object) -> list[dict] | None:
    """The entities of an answer: a list of them, or of lists of them; anything else in it is passed over."""
    if not isinstance(body, list):
        return None
    flat = [e for part in body for e in (part if isinstance(part, list) else [part])]
    return [{"pos": i, "entity_group": str(e.get("entity_group", e.get("entity", ""))), "word": str(e.get("word", "")).strip(), "score": float(e.get("score", 0.0))} for i, e in enumerate(flat) if isinstance(e, dict)]


def recognise(cases: DataFrame, service: Service, *, text: str = "case_text", out: str = "entities", parallel: int = 4) -> DataFrame:
    """SRC-10: cases with the entities that the service finds in each text, and the outcome; ``missing`` and ``failed`` leave rules to do the work."""
    return _asked(cases, service, text, parallel, out, T.ArrayType(_ENTITY), entities_of, _ENTITY_ARROW)


def drain(rows: DataFrame, ask: Callable[[DataFrame], DataFrame], *, rounds: int = 5, most_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A queue: rows whose model was loading are asked again, after the longest wait told (at most most_wait), until none is left or the rounds are over.

    Each round's answers are a table, so nothing that was answered is asked again; what still loads after the last round stays ``loading``.
    """
    columns, answered, queue = rows.columns, [], rows
    for n in range(rounds):
        told = stored(ask(queue), "answers")
        loading = told.filter(F.col("status") == LOADING)
        left = loading.agg(F.count("*").alias("n"), F.max("retry_after").alias("wait")).first()
        if not left["n"] or n == rounds - 1:
            answered.append(told)
            break
        answered.append(told.filter(F.col("status") != LOADING))
        queue = loading.select(*columns)
        sleep(min(most_wait, left["wait"] or 0.0))
    out = answered[0]
    for more in answered[1:]:
        out = out.unionByName(more)
    return out
