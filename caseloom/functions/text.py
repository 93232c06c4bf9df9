"""Text helpers as column expressions; all null-safe in the way their callers need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of Unicode's White_Space, as in Java's (?U)\s.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often and in whatever lambdas use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or(c: Column, other: str = "") -> Column:
    return F.coalesce(c, F.lit(other))


def strip(c: Column) -> Column:
    """All white space at both ends, not blanks alone."""
    return F.btrim(c, F.lit(SPACE))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def null_if_empty(c: Column) -> Column:
    """c, or NULL for ''; c, often a search of a whole text, is worked out once, which NULLIF in a branch does not do."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def lowered(text: Column) -> Column:
    """The text in lower case for ``mentions``; NULL for texts beyond ASCII, where case folds further."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text))


def mentions(low: Column, words: tuple[str, ...]) -> Column:
    """False only where no word, in whatever case, can stand in the text that ``lowered`` gave low for."""
    found = F.lit(False)
    for word in words:
        found = found | low.contains(word)
    return F.coalesce(found, F.lit(True))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL (not '') without one."""
    return null_if_empty(F.regexp_extract(text, pattern, group))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def set_sorted(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def cut_at_space(c: Column, most: int, end: str = "...") -> Column:
    """Texts beyond ``most`` characters: the first ``most``, back to the last space if there is one, and the mark."""
    return bound(c, lambda x: F.when(F.length(x) > most, F.concat(F.regexp_replace(F.substring(x, 1, most), r" [^ ]*\z", ""), F.lit(end))).otherwise(x))


def shortened(c: Column, most: int, end: str = "…") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(end))).otherwise(c)


def size0(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def slug(prefix: Column | str, label: Column) -> Column:
    """prefix:label in lower case, blanks and slashes as underscores, at most 60 characters."""
    first = F.substring(strip(F.lower(label)), 1, 60)
    body = F.rtrim(F.replace(F.replace(first, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_")), F.lit("_"))
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit(":"), F.coalesce(null_if_empty(body), F.lit("node")))


def iso_date(raw: Column) -> Column:
    """D-M-YYYY or D/M/YYYY at the start, or a whole "D Month YYYY", as YYYY-MM-DD; else the text, '' as NULL."""
    s = strip(raw)
    numbers = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    numeric = F.concat_ws("-", *[F.regexp_extract(s, numbers, i) for i in (1, 2, 3)])
    words = r"(?i)^(\d{1,2})\s+(january|february|march|april|may|june|july|august|september|october|november|december)\s+(\d{4})\z"
    named = F.concat_ws(" ", F.regexp_extract(s, words, 1), F.initcap(F.regexp_extract(s, words, 2)), F.regexp_extract(s, words, 3))
    day = F.when(s.rlike(numbers), F.try_to_date(numeric, "d-M-yyyy")).when(s.rlike(words), F.try_to_date(named, "d MMMM yyyy"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), null_if_empty(s))
