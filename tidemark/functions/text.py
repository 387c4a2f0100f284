"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_entities(c: Column) -> Column:
    """Fixed values, in the order in which they are replaced."""
    for entity, mark in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#x2F;", "/"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return c


def strip_html(c: Column) -> Column:
    """Visible text: scripts, styles and tags become blanks, entities are decoded, white space collapses."""
    c = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]*>", " ")), "[ \\t\\r\\n]+", " "))


def lookup_key(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(c), F.lit("&amp;"), F.lit("&")), "[^a-z0-9&]+", "")


def ticker_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", "")


def company_id(c: Column) -> Column:
    return F.concat(F.lit("company_"), F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def is_us_symbol(c: Column) -> Column:
    return c.rlike("^[A-Z][A-Z0-9-]{0,9}$")


def symbol_list(c: Column) -> Column:
    """Comma or blank separated symbols: trimmed, upper case, valid ones once each, in order."""
    return F.array_distinct(F.filter(F.split(F.upper(F.trim(c)), "[,\\s]+"), lambda s: s.rlike("^[A-Z0-9.\\-]{1,16}$")))


def symbol_spellings(c: Column) -> Column:
    """Distinct spellings under which a close series may be listed, in order of preference."""
    low = F.lower(F.trim(c))
    return F.array_distinct(F.array(F.concat(low, F.lit(".us")), F.concat(F.replace(low, F.lit("."), F.lit("-")), F.lit(".us")), F.concat(F.replace(low, F.lit("."), F.lit("")), F.lit(".us")), low))


def user_of_token(c: Column, default: str = "demo-user") -> Column:
    user = F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), "dev-token:(.*)$", 1))
    return F.when(user == "", default).otherwise(user)


def user_slug(user: Column, name: Column, default: str = "demo-user") -> Column:
    blank = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return F.coalesce(blank(user), blank(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]+", "-")), F.lit(default))


def visual_length(c: Column) -> Column:
    """Characters, those beyond Latin-1 twice."""
    return (F.length(c) + F.length(F.regexp_replace(c, "[\\x00-\\xff]", ""))).cast("long")


def keyword_matches(keyword: str, *columns: Column) -> Column:
    """True where the keyword stands, in any case, in the joined columns; an empty one matches all."""
    key = keyword.strip().lower()
    return F.lower(F.concat_ws(" ", *columns)).contains(key) if key else F.lit(True)


#: What pages say that carry no data.
REJECTED = [
    "exceeded the daily hits limit",
    "too many requests",
    "sad-panda-201402200631.png",
    "no longer be accessible from mainland china",
    "enable javascript and cookies to continue",
    "<title>just a moment",
]


def is_rejected_payload(c: Column) -> Column:
    """Empty texts and pages of access control or rate limits."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    hit = F.exists(F.array(*[F.lit(x) for x in REJECTED]), lambda x: F.contains(t, x))
    return (t == "") | hit | (t.contains("just a moment") & t.contains("cf-chl"))


def has_source_tag(source: Column, tags: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t.lower()) for t in tags]), lambda t: F.contains(F.lower(source), t))


def id_list(c: Column) -> Column:
    """A stored list of ids: a JSON array as text; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def known_ids(catalogue: list[str], most: int, *lists: Column) -> Column:
    """Known ids of several lists, distinct in order, at most so many."""
    return F.slice(F.array_intersect(F.concat(*lists), F.array(*[F.lit(x) for x in catalogue])), 1, most)


def included(symbol: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a symbol is on the include list (a star stands for all) and not on the exclude list."""
    return (F.lit("*" in include) | symbol.isin(include)) & ~symbol.isin(exclude)
