"""Document fingerprints: a Merkle tree over sections and paragraphs, in column functions only.

Sections are parted by an empty line, paragraphs by a line end, and a paragraph's leaves are its sentences, cut at
``LEAF`` code points. Every leaf, paragraph, section and the root has a SHA-256 over its children, so equal roots mean
equal texts and, going down where digests differ, the branches that were edited (``with_edits``). The fingerprint is a
string of four parts joined by ``:``, one per level: the root's 64 hex digits; the first 8 digits of the leaves, with ``;``
between sections, ``,`` between paragraphs and ``.`` between leaves; the first 16 of the paragraphs, with ``;`` between
sections; the first 16 of the sections.

Defined results: null text -> empty text. Likeness is 1 for equal roots, else twice the common distinct leaves over the
sum of both numbers of distinct leaves (0 if there are none). Very long paragraphs become many leaves. Of rows with a
repeated id each is edited with the next greater id; where several rows have that id, the one with the least text serves.
Rows with a null id have no next document and count as followed by an empty text. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import whole

LEAF = 200
EDITS = "array<struct<section:int,paragraph:int,leaves:array<int>>>"
_SENTENCE = f"[^.!?]{{1,{LEAF}}}[.!?]*|[.!?]+"


def leaf_digests(text: Column) -> Column:
    """By section and paragraph: array<array<array<string>>>."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_SENTENCE), F.lit(0)), lambda leaf: F.sha2(leaf, 256))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def over(children: Column) -> Column:
    """The digest of a node from those of its children."""
    return F.sha2(F.array_join(children, ""), 256)


def _short(digests: Column, digits: int) -> Column:
    return F.transform(digests, lambda d: F.substring(d, 1, digits))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column; each level is computed once, from the one below it."""
    others = [c for c in df.columns if c not in (out, "_leaves", "_paragraphs", "_sections")]
    levels = df.select(*others, leaf_digests(whole(F.col(text))).alias("_leaves"))
    levels = levels.withColumn("_paragraphs", F.transform("_leaves", lambda s: F.transform(s, over)))
    levels = levels.withColumn("_sections", F.transform("_paragraphs", over))
    leaves = F.array_join(F.transform("_leaves", lambda s: F.array_join(F.transform(s, lambda p: F.array_join(_short(p, 8), ".")), ",")), ";")
    paragraphs = F.array_join(F.transform("_paragraphs", lambda s: F.array_join(_short(s, 16), ".")), ";")
    sections = F.array_join(_short(F.col("_sections"), 16), ".")
    return levels.select(*others, F.concat_ws(":", over(F.col("_sections")), leaves, paragraphs, sections).alias(out))


def root(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def _level(fingerprint: Column, at: int) -> Column:
    return F.split_part(fingerprint, F.lit(":"), F.lit(at))


def _leaves(fingerprint: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_level(fingerprint, 2), "[.,;]", -1), lambda x: x != ""))


def _alike(same: Column, x: Column, y: Column) -> Column:
    both = F.size(x) + F.size(y)
    return F.when(same, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(x, y)) / both)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints alone."""
    return _alike(root(a) == root(b), _leaves(a), _leaves(b))


def with_edits(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with where fingerprint a was edited against fingerprint b: array<struct<section, paragraph, leaves>>, all numbers from 0.

    The descent begins at the roots. A section of a whose digest b has is not entered, nor is a paragraph; in each one
    left the leaves that b has nowhere are named. Equal roots give an empty array.
    """
    level = lambda name, at, marks: F.split(_level(F.col(name), at), marks, -1)
    new = lambda at, marks: F.array_except(level(a, at, marks), level(b, at, marks))
    staged = df.withColumns({"_new_sections": new(4, "\\."), "_new_paragraphs": new(3, "[.;]"), "_new_leaves": new(2, "[.,;]")})
    # Two mentions each, so that the columns stay columns: within a lambda they would be computed for every item.
    is_new = lambda name, x: (F.size(name) > 0) & F.array_contains(name, x)

    def leaves(of: Column) -> Column:
        return F.filter(F.transform(F.split(of, "\\.", -1), lambda x, i: F.when((x != "") & is_new("_new_leaves", x), i)), lambda i: i.isNotNull())

    def paragraphs(section: Column) -> Column:
        both = F.zip_with(F.split(section["paragraphs"], "\\.", -1), F.split(section["leaves"], ",", -1), lambda d, x: F.struct(d.alias("digest"), x.alias("leaves")))
        placed = F.filter(F.transform(both, lambda p, i: F.struct(i.alias("at"), p["digest"].alias("digest"), p["leaves"].alias("leaves"))), lambda p: is_new("_new_paragraphs", p["digest"]))
        return F.transform(placed, lambda p: F.struct(section["at"].alias("section"), p["at"].alias("paragraph"), leaves(p["leaves"]).alias("leaves")))

    below = F.zip_with(level(a, 3, ";"), level(a, 2, ";"), lambda p, x: F.struct(p.alias("paragraphs"), x.alias("leaves")))
    every = F.zip_with(level(a, 4, "\\."), below, lambda d, x: F.struct(d.alias("digest"), x["paragraphs"].alias("paragraphs"), x["leaves"].alias("leaves")))
    entered = F.filter(
        F.transform(every, lambda s, i: F.struct(i.alias("at"), s["digest"].alias("digest"), s["paragraphs"].alias("paragraphs"), s["leaves"].alias("leaves"))),
        lambda s: is_new("_new_sections", s["digest"]),
    )
    edits = F.when(root(F.col(a)) == root(F.col(b)), F.array().cast(EDITS)).otherwise(F.flatten(F.transform(entered, paragraphs)))
    return staged.withColumn(out, edits).drop("_new_sections", "_new_paragraphs", "_new_leaves")


def range_starts(keys: DataFrame, key: str, parts: int) -> list:
    """The least key of each of at most ``parts`` ranges with about as many keys each, in order; null keys are left out."""
    ranged = keys.filter(F.col(key).isNotNull()).select(key).repartitionByRange(parts, F.col(key))
    found = ranged.withColumn("_part", F.spark_partition_id()).groupBy("_part").agg(F.min(key).alias("first"))
    return sorted(r["first"] for r in found.collect())


def part_of(key: Column, starts: Column, parts: int) -> Column:
    """The number of the range that a key, not less than the first start, falls in: by halving."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"] + 1, 1)
        reached = F.get(starts, middle) <= key
        return F.struct(F.when(reached, middle).otherwise(acc["low"]).alias("low"), F.when(reached, acc["high"]).otherwise(middle - 1).alias("high"))

    everywhere = F.struct(F.lit(0).alias("low"), F.lit(parts - 1).alias("high"))
    return F.aggregate(F.array_repeat(F.lit(0), parts.bit_length()), everywhere, halve, lambda acc: acc["low"])


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """_id, _text, fingerprint, next_text and next_fingerprint (both null where no document is next).

    Rows are dealt once, by range of the key, into ``parts`` (spark.sql.shuffle.partitions) parts; only the least key of each
    comes to the driver. The first document of a range goes to the end of the range before it too, as a mere neighbour, so that
    the next document is always one row further down in the same part.
    """
    rows = docs.select(F.col(key).alias("_id"), whole(F.col(text)).alias("_text"))
    found = range_starts(rows, "_id", parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = max(1, len(found))
    starts = F.lit(found).cast(T.ArrayType(rows.schema["_id"].dataType)) if found else F.array().cast(T.ArrayType(rows.schema["_id"].dataType))
    without = F.pmod(F.xxhash64("_text"), F.lit(n)).cast("int")
    placed = rows.withColumn("_part", F.when(F.col("_id").isNull(), without).otherwise(part_of(F.col("_id"), starts, n)))
    first = F.col("_id") == F.get(starts, F.col("_part"))
    own = F.struct(F.col("_part").alias("_at"), F.lit(False).alias("_tail"))
    before = F.when(first, F.struct(F.pmod(F.col("_part") - 1, F.lit(n)).alias("_at"), F.lit(True).alias("_tail")))
    dealt = placed.select("_id", "_text", F.inline(F.array_compact(F.array(own, before)))).repartitionById(n, F.col("_at"))
    order = Window.partitionBy("_at").orderBy("_tail", "_id", "_text")
    # Rows of one id all go on with what follows the last of them.
    one_id = Window.partitionBy("_at", "_tail", "_id").orderBy("_text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    led = with_fingerprint(dealt, "_text", "fingerprint").select("*", F.lead("_text").over(order).alias("_next"), F.lead("fingerprint").over(order).alias("_next_print"))
    known = F.col("_id").isNotNull()
    led = led.select("*", F.last("_next").over(one_id).alias("_after"), F.last("_next_print").over(one_id).alias("_after_print")).filter("not _tail")
    return led.select("_id", "_text", "fingerprint", F.when(known, F.col("_after")).alias("next_text"), F.when(known, F.col("_after_print")).alias("next_fingerprint"))


def compare_with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """key, n_chars, edited_text, the fingerprints of text and edited text, their differing branches, and likeness to the edited text and to the next document.

    The edited text is the text with its last quarter replaced by as much of the next document's start.
    """
    n = F.length("_text")
    quarter = F.floor(n / 4).cast("int")
    end = F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter)
    edited = with_next(docs, key=key, text=text, parts=parts).select(
        F.col("_id").alias(key), n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("_text"), F.lit(1), n - quarter), end).alias("edited_text"), "fingerprint", "next_fingerprint"
    )
    empty = with_fingerprint(docs.sparkSession.range(1).select(F.lit("").alias("t")), "t", "f").first()["f"]
    prints = with_fingerprint(edited, "edited_text", "edited_fingerprint").withColumn("next_fingerprint", F.coalesce("next_fingerprint", F.lit(empty)))
    prints = with_edits(prints, "edited_fingerprint", "fingerprint", "edits")
    leaves = {f"_of_{name}": _leaves(F.col(name)) for name in ("fingerprint", "edited_fingerprint", "next_fingerprint")}
    alike = lambda name: _alike(root(F.col("fingerprint")) == root(F.col(name)), F.col("_of_fingerprint"), F.col(f"_of_{name}"))
    return prints.withColumns(leaves).select(
        key, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "edits", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next")
    )
