"""Remote search and documents (SRC-4, SRC-5), for use where there is a network; transports are parameters, so tests need none.

``judgment_search`` is a Python data source. Its queries are partitions, and predicates on query, court and year become fields of the
request (``spark.sql.python.filterPushdown.enabled``): ``query = ..`` or ``in (..)`` names the queries, ``court = ..`` and bounds on ``year`` go with each
of them and are the service's to keep, since its rows do not say which court code or year they were found by. Everything else is left to Spark.

``fetch_documents`` reads many documents in the tasks. Each host has a stated number of lanes, and a lane waits between its requests, so
the rate for a host holds however many executors there are. A document that can't be had is a row with status 502, not a failed task.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..operators.html import search_rows
from ..rules import SITE

SCHEMA = "query string, ordinal int, title string, url string, doc_id string, court string, date string, snippet string, year int, status int, error string"
DOCUMENT = "doc_id string, url string, status int, error string, html string"


def search_url(query: str, *, court: str | None = None, year_from: int | None = None, year_to: int | None = None, page: int = 0) -> str:
    fields = {"formInput": query, "order": "date", "court": court, "minYear": year_from, "maxYear": year_to, "pagenum": page or None}
    return f"{SITE}/search/?" + urllib.parse.urlencode({k: v for k, v in fields.items() if v is not None})


def judgment_url(doc_id: str) -> str:
    return f"{SITE}/doc/{doc_id}/"


def fetch(url: str, timeout: float = 30.0, pause: float = 0.5) -> str:
    """One page, after a polite pause; OSError where it can't be had."""
    time.sleep(pause)
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read().decode("utf-8", "replace")


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _Reader(DataSourceReader):
    """One request for each query. ``asked`` holds what predicates have added to the options."""

    def __init__(self, options: dict[str, str], get: Callable[[str], str]):
        self.get = get
        self.limit = int(options.get("limit", "10"))
        self.queries = [q for q in options.get("queries", "").split("\n") if q]
        year = lambda k: int(options[k]) if options.get(k) else None
        self.court, self.year_from, self.year_to = options.get("court"), year("year_from"), year("year_to")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._took(f):
                yield f

    def _took(self, f: Filter) -> bool:
        if isinstance(f, IsNotNull) and f.attribute in (("query",), ("court",), ("year",)):
            return True
        of = getattr(f, "attribute", None)
        if of == ("query",) and isinstance(f, (EqualTo, In)):
            named = [f.value] if isinstance(f, EqualTo) else [v for v in f.value if v is not None]
            self.queries = [q for q in dict.fromkeys(named) if not self.queries or q in self.queries] or [None]
            return True
        if of == ("court",) and isinstance(f, EqualTo) and self.court in (None, f.value):
            self.court = f.value
            return True
        if of == ("year",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else None
            high = f.value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
            self.year_from = low if self.year_from is None else self.year_from if low is None else max(low, self.year_from)
            self.year_to = high if self.year_to is None else self.year_to if high is None else min(high, self.year_to)
            return True
        return False

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries] or [_Query(None)]

    def read(self, partition: _Query) -> Iterator[tuple]:
        if partition.query is None or (self.year_from is not None and self.year_to is not None and self.year_from > self.year_to):
            return
        try:
            page = self.get(search_url(partition.query, court=self.court, year_from=self.year_from, year_to=self.year_to))
        except OSError as error:
            yield partition.query, 0, None, None, None, None, None, None, None, 502, f"Unable to reach the search: {error}"
            return
        for i, r in enumerate(search_rows(page)[: self.limit]):
            date = r["date"] or ""
            yield partition.query, i, r["title"], r["url"], r["doc_id"], r["court"], r["date"], r["snippet"], int(date[:4]) if date[:4].isdigit() else None, 200, None


def register(spark: SparkSession, get: Callable[[str], str] = fetch, name: str = "judgment_search") -> None:
    """SRC-4: spark.read.format(name).option("queries", "one per line").load(), with predicates on query, court and year; also options court, year_from, year_to, limit.

    A search that fails is one row with status 502 and what went wrong; rows found have 200.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), get)

    spark.dataSource.register(Search)


def read_page(url: str, timeout: float = 30.0) -> tuple[int, str]:
    """(status, body) of a page; OSError where there is no answer."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, ""


def fetch_documents(
    asked: DataFrame, get: Callable[[str], tuple[int, str]] = read_page, *, pause: float = 0.5, lanes: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """SRC-5: (doc_id, url, status, error, html) for each asked (doc_id[, url]); a null url is the site's own page of the id.

    status is 200, or 502 with the reason: no answer, or an answer other than 200. A host has ``lanes`` tasks at most, each of which keeps
    ``pause * lanes`` seconds between the starts of its requests to it, so a host gets one request in ``pause`` seconds. Ids asked more than once are fetched once.
    """
    url = F.coalesce(F.col("url"), F.lit(None).cast("string")) if "url" in asked.columns else F.lit(None).cast("string")
    own = F.concat(F.lit(judgment_url("")[:-1]), F.col("doc_id").cast("string"), F.lit("/"))
    rows = asked.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(url, own).alias("url")).filter("doc_id is not null").dropDuplicates(["doc_id", "url"])
    host = F.lower(F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit("")))
    dealt = rows.withColumn("_lane", F.concat_ws("#", host, F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("string")))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun: dict[str, float] = {}
        for frame in frames:
            out = []
            for doc_id, page, lane in zip(frame["doc_id"], frame["url"], frame["_lane"], strict=True):
                if lane in begun and (wait := begun[lane] + pause * lanes - clock()) > 0:
                    sleep(wait)
                begun[lane] = clock()
                try:
                    status, body = get(page)
                    out.append((doc_id, page, 200, None, body) if status == 200 else (doc_id, page, 502, f"Unable to fetch {doc_id}: answer {status}", None))
                except OSError as error:
                    out.append((doc_id, page, 502, f"Unable to fetch {doc_id}: {error}", None))
            yield pd.DataFrame(out, columns=["doc_id", "url", "status", "error", "html"])

    # All of a lane in one task: its pauses are the rate.
    return dealt.repartition("_lane").mapInPandas(read, DOCUMENT)
