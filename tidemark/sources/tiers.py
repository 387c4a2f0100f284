"""Series and ratios out of page texts in ordered passes: a later pass runs only where the ones before gave too little."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import month_end_of, month_year_date
from tidemark.functions.numbers import parse_number_text
from tidemark.functions.text import strip_html
from tidemark.operators.valuation import usable

PAIRS = "array<struct<date:date,value:double>>"
#: What a monthly ratio may be; months that are enough to leave out the last pass; the patterns of the passes.
LOW, HIGH, ENOUGH_MONTHS = 0.0, 250.0, 12
NUMBER = r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"
SIGNED = r"([-+]?[0-9]+(?:\.[0-9]+)?)"
MONTH = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
MONTH_CELL = rf"(?i)<td[^>]*>\s*([A-Za-z]{{3,9}}\s+[12][0-9]{{3}})\s*</td>\s*<td[^>]*>\s*{NUMBER}\s*</td>"
MONTH_LINE = rf"(?i)\b({MONTH}\s+[12][0-9]{{3}})\s*\|?\s*([0-9]+(?:\.[0-9]+)?)"
KEYED = r'"(?:Date|date)"\s*:\s*"([^"]+)"[\s\S]{0,180}?"(?:Value|value)"\s*:\s*("?[-+]?[0-9]+(?:\.[0-9]+)?"?)'
EPOCH_PAIR = rf"\[(\d{{10,13}})\s*,\s*{SIGNED}\]"
ISO_PAIR = rf'\["?([12]\d{{3}}-\d{{2}}(?:-\d{{2}})?)"?\s*,\s*{SIGNED}\]'
DATED_CELL = rf"(?i)<td[^>]*>\s*([A-Za-z]{{3,9}}\s+[12]\d{{3}}|\d{{4}}-\d{{2}}(?:-\d{{2}})?)\s*</td>\s*<td[^>]*>\s*{SIGNED}\s*</td>"

Pass = Callable[[Column], Column]


def pairs(pattern: str, date: Pass, value: Pass = parse_number_text, groups: tuple[int, int] = (1, 2), low: float = LOW, high: float = HIGH) -> Pass:
    """A pass that gives (date, value) of every match of a pattern, in order, where both can be read and the value is in range."""

    def run(text: Column) -> Column:
        both = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for g, n in zip(groups, "dv")])
        read = F.transform(both, lambda p: F.struct(date(p["d"]).alias("date"), value(p["v"]).alias("value")))
        return F.filter(read, lambda p: p["date"].isNotNull() & (p["value"] > low) & (p["value"] <= high)).cast(PAIRS)

    return run


def in_passes(df: DataFrame, key: str, text: str, tiers: list[tuple[int, list[Pass]]], keep: str) -> DataFrame:
    """(key, date, value) by tiers of passes over a text.

    The passes of a tier run in order. A tier runs only for texts where the tiers before gave fewer dates
    than its number says (0: always). Of a date's values the ``first`` or the ``last`` counts, in the order
    of tiers, passes and matches.
    """
    found = F.array().cast(PAIRS)
    for least, passes in tiers:
        more = F.concat(found, *[p(F.col(text)) for p in passes])
        found = more if not least else F.when(F.size(F.array_distinct(F.transform(found, lambda p: p["date"]))) < least, more).otherwise(found)
    rows = df.select(key, F.posexplode(found).alias("__at", "__p")).select(key, "__at", "__p.*")
    return rows.groupBy(key, "date").agg((F.min_by if keep == "first" else F.max_by)("value", "__at").alias("value"))


def _month_and_year(c: Column) -> Column:
    part = F.split(F.trim(c), r"\s+")
    return month_year_date(F.get(part, F.lit(0)), F.get(part, F.lit(1)))


def plain_lines(html: Column) -> Column:
    """Text with a line to each block element, tags and runs of blanks taken out."""
    c = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style.*?</style>", " ")
    c = F.regexp_replace(c, r"(?i)</(p|div|li|tr|h[1-6]|table|section)>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "(?i)&nbsp;|\r", " ")
    return F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n+", "\n")


def monthly_table_or_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Month ends with ratios from table cells; from lines of the visible text only where no cell gives any. The first of a month counts."""
    cells = pairs(MONTH_CELL, _month_and_year)
    lines = pairs(MONTH_LINE, _month_and_year, groups=(1, 3))
    return in_passes(df, key, text, [(0, [cells]), (1, [lambda c: lines(plain_lines(c))])], "first")


def monthly_page(df: DataFrame, key: str, text: str) -> DataFrame:
    """Month ends with ratios from keyed records, epoch pairs and ISO pairs; from table cells only under twelve months. The last of a month counts."""
    cell_date = lambda c: F.coalesce(_month_and_year(c), month_end_of(c))
    always = [pairs(p, month_end_of) for p in (KEYED, EPOCH_PAIR, ISO_PAIR)]
    always[0] = pairs(KEYED, month_end_of, lambda v: parse_number_text(F.replace(v, F.lit('"'), F.lit(""))))
    return in_passes(df, key, text, [(0, always), (ENOUGH_MONTHS, [pairs(DATED_CELL, cell_date)])], "last")


#: Labels of the ratios on a statistics page, with the least and greatest value.
LABELS = {
    "pe_ttm": (["Trailing P/E"], 2, 400),
    "pe_forward": (["Forward P/E"], 2, 400),
    "pb": (["Price/Book"], 0.01, 400),
    "peg": (["PEG Ratio (5 yr expected)", "PEG Ratio (5yr expected)"], -100, 100),
}
RAW_KEYS = ["trailingPE", "trailingPe"]
MEASURES_SOURCE, RAW_SOURCE = "yahoo-key-statistics-valuation-measures", "yahoo-key-statistics-latest-raw"


def labelled(text: Column, labels: list[str], low: float, high: float) -> Column:
    """The last number in range that follows one of the labels, over all readings of a page, labels and patterns, in this order."""
    unquoted, unslashed = F.replace(text, F.lit('\\"'), F.lit('"')), F.replace(text, F.lit("\\/"), F.lit("/"))
    readings = [text, unquoted, unslashed, F.replace(unquoted, F.lit("\\/"), F.lit("/")), strip_html(text)]
    found = []
    for reading in readings:
        for label in map(re.escape, labels):
            for pattern in (rf"{label}[^0-9\-]{{0,120}}(-?\d+(?:\.\d+)?)", rf"{label}[\s\S]{{0,220}}?<td[^>]*>\s*(-?\d+(?:\.\d+)?)\s*<", rf'"label"\s*:\s*"{label}"[\s\S]{{0,220}}?"raw"\s*:\s*(-?\d+(?:\.\d+)?)'):
                found.append(F.regexp_extract_all(reading, F.lit(f"(?i){pattern}"), F.lit(1)))
    values = F.transform(F.concat(*found), lambda x: usable(x.try_cast("double")))
    return F.try_element_at(F.filter(values, lambda x: x.between(low, high)), F.lit(-1))


def statistics_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ratios, source) of a statistics page: labelled values, and the raw trailing ratio where no label gives one."""
    page = F.coalesce(F.col(text), F.lit(""))
    raw = []
    for name in RAW_KEYS:
        for reading in (page, F.replace(page, F.lit('\\"'), F.lit('"'))):
            raw.append(usable(F.regexp_extract(reading, rf'(?i)"{name}"\s*:\s*\{{[^{{}}]{{0,320}}?"raw"\s*:\s*(-?\d+(?:\.\d+)?)', 1).try_cast("double")))
    out = df.select(key, *[labelled(page, labels, low, high).alias(m) for m, (labels, low, high) in LABELS.items()], F.coalesce(*raw).alias("__raw"))
    some = F.coalesce(*LABELS).isNotNull()
    source = F.concat_ws("+", F.when(some, F.lit(MEASURES_SOURCE)), F.when(F.col("__raw").isNotNull(), F.lit(RAW_SOURCE)))
    out = out.where(some | F.col("__raw").isNotNull())
    return out.select(key, F.coalesce("pe_ttm", "__raw").alias("pe_ttm"), "pe_forward", "pb", "peg", source.alias("source"))
