"""Rows out of single providers' pages: ratio series in scripts, lists of companies, ratio time series, the ratio of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import epoch_date
from tidemark.functions.text import decode_entities
from tidemark.operators.merge import keep_best
from tidemark.operators.valuation import usable

#: The first day of history, the years that a page may name, and the patterns of the pages.
HISTORY_START, FIRST_YEAR, LAST_YEAR = "2000-01-01", 1900, 2100
DAILY_DATA, YEARLY_DATA = r"data\s*=\s*(\[\{[\s\S]*?\}\]);", r"data\s*=\s*(\{[\s\S]*?\});"
COMPANY = (
    r'<tr><td class="fav">[\s\S]*?<td class="rank-td td-right"[^>]*data-sort="(\d+)"[^>]*>[\s\S]*?</td><td class="name-td">[\s\S]*?<a href="/([^"/]+)/marketcap/"[\s\S]*?'
    r'<div class="company-name">([\s\S]*?)</div><div class="company-code">[\s\S]*?</span>\s*([^<\s]+)\s*</div>[\s\S]*?</td><td class="td-right" data-sort="(\d+)"'
)
PAGE_RATIO = [r'(?i)"peRatio":"([0-9.]+)"', r'(?i)"peRatio":([0-9.]+)']
PLAIN_RATIO = r"(?i)PE Ratio\s*([0-9]+(?:\.[0-9]+)?)"


def ratio_series(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, date, value) of a page's script: its longest array of dated values; the fullest object of years where no array gives any.

    Years stand for their last day. Days before 2000 and values of zero go; of one day the last counts.
    """
    kind = "array<struct<d:string,v:string>>"
    arrays = F.transform(F.regexp_extract_all(text, F.lit(DAILY_DATA), F.lit(1)), lambda m: F.coalesce(F.from_json(m, kind, {"mode": "PERMISSIVE"}), F.array().cast(kind)))
    longest = F.aggregate(arrays, F.array().cast(kind), lambda best, a: F.when(F.size(a) > F.size(best), a).otherwise(best))
    daily = F.transform(longest, lambda x: F.struct(epoch_date(x["d"].try_cast("double")).alias("date"), usable(x["v"].try_cast("double")).alias("value")))
    ok = lambda p: p["date"].isNotNull() & p["value"].isNotNull() & (p["date"] >= F.lit(HISTORY_START).cast("date"))
    daily = F.filter(daily, ok)
    entries = lambda m: F.map_entries(F.coalesce(F.from_json(m, "map<string,string>"), F.create_map().cast("map<string,string>")))
    year = lambda e: F.when(e["key"].rlike("^[0-9]{4}$") & e["key"].try_cast("int").between(FIRST_YEAR, LAST_YEAR), e["key"])
    pairs = lambda m: F.filter(F.transform(entries(m), lambda e: F.struct(F.try_to_date(F.concat(year(e), F.lit("-12-31")), "yyyy-MM-dd").alias("date"), usable(e["value"].try_cast("double")).alias("value"))), lambda p: p["date"].isNotNull() & p["value"].isNotNull())
    years = F.transform(F.regexp_extract_all(text, F.lit(YEARLY_DATA), F.lit(1)), pairs)
    fullest = F.aggregate(years, F.array().cast("array<struct<date:date,value:double>>"), lambda best, a: F.when(F.size(a) > F.size(best), a).otherwise(best))
    found = F.when(F.size(daily) > 0, daily).otherwise(F.filter(fullest, ok))
    rows = docs.select(key, F.posexplode(found).alias("__at", "__p")).select(key, "__at", "__p.*")
    return rows.groupBy(key, "date").agg(F.max_by("value", "__at").alias("value"))


def top_companies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rank, symbol, slug, display_name, market_cap) of a page's ranked rows; of a symbol the first row that can be used."""
    groups = [F.regexp_extract_all(text, F.lit(COMPANY), F.lit(g)) for g in range(1, 6)]
    rows = docs.select(key, F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("r", "s", "n", "t", "m"))])).alias("__at", "__c"))
    squeezed = lambda c: F.regexp_replace(decode_entities(c), r"\s+", "")
    name = F.trim(F.regexp_replace(decode_entities(F.regexp_replace(F.col("__c.n"), "<[^>]+>", " ")), r"\s+", " "))
    rows = rows.select(
        key, "__at", F.col("__c.r").try_cast("long").alias("rank"), F.upper(squeezed(F.col("__c.t"))).alias("symbol"), F.lower(squeezed(F.col("__c.s"))).alias("slug"), name.alias("display_name"), F.col("__c.m").try_cast("double").alias("market_cap")
    )
    rows = rows.where((F.col("rank") > 0) & (F.col("symbol") != "") & (F.col("slug") != "") & (F.col("market_cap") > 0))
    return keep_best(rows, [key, "symbol"], "__at").drop("__at")


def ratio_timeseries(docs: DataFrame, key: str, text: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(key, date, value) and the latest (key, date, value) of a time-series payload's first list of entries of one kind; of a date the later entry counts."""
    schema = f"timeseries struct<result:array<struct<`{kind}`:array<struct<asOfDate:string,reportedValue:struct<raw:string>>>>>>"
    lists = F.transform(F.from_json(text, schema)["timeseries"]["result"], lambda r: r[kind])
    rows = docs.select(key, F.posexplode(F.get(F.filter(lists, lambda x: F.size(x) > 0), F.lit(0))).alias("__at", "__e"))
    rows = rows.select(key, "__at", F.try_to_date(F.col("__e.asOfDate"), "yyyy-MM-dd").alias("date"), usable(F.expr("try_cast(__e.reportedValue.raw AS DOUBLE)")).alias("value")).where("date IS NOT NULL AND value IS NOT NULL")
    anchors = rows.groupBy(key, "date").agg(F.max_by("value", "__at").alias("value"))
    return anchors, rows.groupBy(key).agg(F.max(F.struct("date", "__at", "value")).alias("__l")).select(key, "__l.date", "__l.value")


def page_ratio(html: Column) -> Column:
    """The ratio that a fund's page names: in its data as text or number, else in the visible text; only positive ones."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "<[^>]+>", " "), "(?i)&nbsp;", " "), r"\s+", " ")
    texts = [F.regexp_extract(html, p, 1) for p in PAGE_RATIO] + [F.regexp_extract(plain, PLAIN_RATIO, 1)]
    value = F.coalesce(*[F.when(t != "", t) for t in texts]).try_cast("double")
    return F.when((value > 0) & (value < float("inf")), value)


def market_date(closes: DataFrame, today: Column, date: str = "date") -> DataFrame:
    """One row: the latest date of the reference symbols' charts, null if it lies more than a day ahead of ``today``."""
    return closes.agg(F.max(date).alias("d")).select(F.when(F.col("d") <= F.date_add(today, 1), F.col("d")).alias("market_date"))
