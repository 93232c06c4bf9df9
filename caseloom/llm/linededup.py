"""Line deduplication by site-relative frequency.

Within a host, a line's ratio is the number of pages that contain it over the number of pages of the host. Lines with a
ratio above ``max_ratio`` on at least ``min_pages`` pages are boilerplate and go from every page of that host; a line
that is boilerplate on one host stays on the others. Lines are compared trimmed of blanks, by their 128-bit digest within the
host; blank lines are never boilerplate.

Counts are pre-aggregated before their one shuffle, keyed by (host, line), so a hot host or line is spread. The lines found are few
(at most mean lines per page / max_ratio a host), so they go to the pages as one array per host: sent round while there are at most
``broadcast_lines`` of them, beyond that by a join on the host and a salt, which moves each page once. Both ways give the same rows.
Pages of hosts with under ``min_pages`` pages keep all lines; min_pages = 1 judges every host by its ratio alone.

Defined results: null text -> no lines, text ''. A null host is a host of its own. A page whose lines all go keeps its row,
with text ''. Repeated rows are pages of their own. A line repeated within a page counts once for that page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole

BLANK = " \t\r"
#: Parts that the pages of a host are dealt into for the join.
SALTS = 64


def lines_of(text: Column) -> Column:
    return F.when(whole(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def line_key(line: Column) -> Column:
    return F.md5(F.btrim(line, F.lit(BLANK)))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(host, line, pages, host_pages) of the lines that exceed the ratio."""
    of = F.coalesce(F.col(host).cast("string"), F.lit("\0"))
    totals = pages.groupBy(of.alias("host")).agg(F.count("*").alias("host_pages"))
    seen = F.array_distinct(F.transform(F.filter(lines_of(F.col(text)), lambda x: F.btrim(x, F.lit(BLANK)) != ""), line_key))
    counts = pages.select(of.alias("host"), F.explode(seen).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    return counts.join(totals, "host").filter(F.col("pages") > max_ratio * F.col("host_pages"))


def drop_boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 5, broadcast_lines: int = 100_000) -> DataFrame:
    """pages with the text that stays, n_lines and n_dropped."""
    columns = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    found = saved(boilerplate(pages, host=host, text=text, max_ratio=max_ratio, min_pages=min_pages), "lines")
    n = found.count()
    pages = pages.select(*columns).withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit("\0")))
    by_host = found.groupBy(F.col("host").alias("_host")).agg(F.collect_list("line").alias("_bad"))
    if n <= broadcast_lines:
        joined = pages.join(F.broadcast(by_host), "_host", "left")
    else:  # each host's array goes to SALTS places, among which its pages are dealt in turn
        dealt = pages.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = dealt.join(by_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_host", "_salt"], "left")
    joined = joined.withColumn("_lines", lines_of(F.col(text)))
    bad = F.coalesce("_bad", F.array().cast("array<string>"))
    kept = F.filter("_lines", lambda x: (F.btrim(x, F.lit(BLANK)) == "") | ~F.array_contains(bad, line_key(x)))
    return _shaped(joined.withColumn("_kept", F.when(F.size(bad) == 0, F.col("_lines")).otherwise(kept)), columns, text)


def _shaped(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    return df.select(*[F.array_join("_kept", "\n").alias(c) if c == text else F.col(c) for c in columns], F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"))
