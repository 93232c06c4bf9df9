"""WARC revisits: "not modified" records get the content of the latest earlier full response to the same URL.

An as-of join by canonical URL: records are dealt by range of (URL, time), so a URL with any share of the records spreads over
parts; within a part a window carries the last full response forward, and what a part needs from those before it comes
from one row per part. No record is joined with more than one other.

A revisit is ``resolved`` if its validators agree with that response's: its ETag (weak comparison) if it has one, else
Last-Modified, else the payload digest; one that disagrees is a ``mismatch``, one with none of the three is ``unvalidated``, one without an
earlier full response is an ``orphan``. Only resolved ones get headers: the response's, updated by those of the revisit that may
change (RFC 9111, 3.2).

Defined results: an earlier response has a strictly lesser time; among responses of one time the greatest record id is the
later. Records with a null URL or time are orphans if they are revisits. Null headers -> none. Rows of other types pass through
unresolved and are not returned. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

#: Header names that a 304 response does not update.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that do not select content.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid")


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. and default port, no scheme, fragment, tracking parameters or closing slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://(?:www\.)?([^/?]*)", 1)), ":(80|443)$", "")
    rest = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    for name in TRACKING:
        query = F.regexp_replace(query, f"(^|&){name}=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _first_of_each(pairs: Column) -> Column:
    """Of pairs with one key, the first."""
    return F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda x: x["key"] == e["key"]))


def _lower_names(headers: Column) -> Column:
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(_first_of_each(pairs))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers with those of the update that may change; names in lower case."""
    allowed = F.map_filter(update, lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, '^W/', "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, status, response_id, payload_digest, headers.

    records: record_id long, url string, ts long or timestamp, record_type string (response / revisit), http_status int,
    payload_digest string, headers map<string,string>. A full response has type response and status 200.
    """
    rows = records.filter(F.col("record_type").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", (F.col("record_type") == "revisit").alias("revisit"),
        ((F.col("record_type") == "response") & (F.col("http_status") == 200)).alias("full"), "payload_digest", _lower_names(F.col("headers")).alias("headers"),
    ).filter("revisit or full")
    # Of equal times revisits come first: what they are resolved to is strictly earlier.
    order = ["ts", F.desc("revisit"), "record_id"]
    ranged = saved(rows.repartitionByRange("canonical_url", "ts", F.desc("revisit"), "record_id").withColumn("part", F.spark_partition_id()), "warc")
    response = F.when(F.col("full") & F.col("ts").isNotNull() & F.col("canonical_url").isNotNull(), F.struct("record_id", "payload_digest", "headers"))
    here = Window.partitionBy("part", "canonical_url").orderBy(*order)
    within = ranged.withColumn("found", F.last(response, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # What goes on from part to part: the last response to the part's last URL, one row per part.
    ends = ranged.groupBy("part").agg(F.min("canonical_url").alias("first_url"), F.max("canonical_url").alias("last_url"))
    last = ranged.join(ends.select("part", F.col("last_url").alias("canonical_url")), ["part", "canonical_url"]).groupBy("part", "canonical_url").agg(F.max_by(response, F.when(response.isNotNull(), F.struct("ts", "record_id"))).alias("carried"))
    asks = ends.select("part", F.col("first_url").alias("canonical_url"), F.lit(0).alias("after"))
    gives = last.select("part", "canonical_url", "carried", F.lit(1).alias("after"))
    before = Window.partitionBy("canonical_url").orderBy("part", "after").rowsBetween(Window.unboundedPreceding, -1)
    carried = asks.unionByName(gives, allowMissingColumns=True).withColumn("earlier", F.last("carried", ignorenulls=True).over(before)).filter("after = 0").select("part", "canonical_url", "earlier")
    joined = within.filter("revisit").join(carried, ["part", "canonical_url"], "left").withColumn("found", F.when(F.col("ts").isNotNull(), F.coalesce("found", "earlier")))
    of = lambda name: (F.col("headers")[name], F.col("found.headers")[name])
    (etag, stored_etag), (modified, stored_modified) = of("etag"), of("last-modified")
    agrees = (
        F.when(etag.isNotNull(), _weak(etag) == _weak(stored_etag))
        .when(modified.isNotNull(), modified == stored_modified)
        .when(F.col("payload_digest").isNotNull(), F.col("payload_digest") == F.col("found.payload_digest"))
    )
    checked = F.when(F.coalesce(etag, modified, "payload_digest").isNull(), "unvalidated").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    status = F.when(F.col("found").isNull(), "orphan").otherwise(checked)
    done = joined.withColumn("status", status)
    got = lambda c: F.when(F.col("status") == "resolved", c)
    return done.select(
        "record_id", "canonical_url", "status", got(F.col("found.record_id")).alias("response_id"), got(F.col("found.payload_digest")).alias("payload_digest"),
        got(merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )


def parse_headers(block: Column) -> Column:
    """A map from the lines of an HTTP header block, names in lower case; the first of a repeated name stays."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n", -1), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    return F.map_from_entries(_first_of_each(pairs))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl of the pages table as WARC records: a full response, later visits, some of them not modified.

    Page p is visited every day, at second p of the day. Day 1: full response. Day 0, if p mod 7 = 0: a revisit before any response. Day 2: a revisit with the ETag (weak where p mod
    3 = 0). Day 3: for p mod 4 = 0 a full response with another ETag, else a revisit by Last-Modified. Day 4: a revisit with the first ETag.
    """
    digest, p = F.md5(F.coalesce("html", F.lit(""))), F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    second = F.concat(F.lit('"v2-'), F.substring(digest, 1, 8), F.lit('"'))
    text = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    modified = F.concat(F.lit("day-1-"), (p % 86400).cast("string"))
    full = lambda t, day: text(("Content-Type", "text/html"), ("Content-Length", F.length(F.coalesce("html", F.lit(""))).cast("string")), ("ETag", t), ("Last-Modified", modified), ("Date", f"day-{day}"), ("Cache-Control", "max-age=60"))

    def record(day: int, kind: Column, headers: Column, of: Column) -> Column:
        revisit = kind == "revisit"
        return F.struct(
            (p * 5 + day).alias("record_id"), (F.lit(day * 86400) + p % 86400).cast("long").alias("ts"), kind.alias("record_type"),
            F.when(revisit, 304).otherwise(200).alias("http_status"), F.when(~revisit, of).alias("payload_digest"), headers.alias("headers"),
        )

    revisit, changed = F.lit("revisit"), p % 4 == 0
    visits = F.array(
        F.when(p % 7 == 0, record(0, revisit, text(("ETag", tag)), digest)),
        record(1, F.lit("response"), full(tag, 1), digest),
        record(2, revisit, text(("ETag", F.when(p % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)), ("Date", "day-2"), ("Content-Length", "0")), digest),
        record(3, F.when(changed, "response").otherwise("revisit"), F.when(changed, full(second, 3)).otherwise(text(("Last-Modified", modified), ("Date", "day-3"), ("Cache-Control", "max-age=120"))), F.md5(F.concat(digest, F.lit("v2")))),
        record(4, revisit, text(("ETag", tag), ("Date", "day-4"), ("X-Cache", "HIT")), digest),
    )
    return pages.select("url", F.explode(F.filter(visits, lambda v: v.isNotNull())).alias("r")).select("url", "r.*")
