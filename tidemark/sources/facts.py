"""Quarterly figures out of company fact documents: every candidate measure is read, and the fullest one is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import quarter_key, text_date
from tidemark.functions.numbers import finite, round_half_up
from tidemark.operators.merge import keep_best

DOCUMENT = "facts map<string,map<string,struct<units:map<string,array<struct<start:string,`end`:string,val:string,filed:string,frame:string,fp:string>>>>>>"
#: Candidate measures of each figure, in order.
MEASURES = {
    "eps": [
        ("us-gaap", "EarningsPerShareDiluted"),
        ("us-gaap", "IncomeLossFromContinuingOperationsPerDilutedShare"),
        ("us-gaap", "EarningsPerShareBasicAndDiluted"),
        ("us-gaap", "EarningsPerShareBasic"),
        ("ifrs-full", "DilutedEarningsLossPerShare"),
        ("ifrs-full", "BasicEarningsLossPerShare"),
    ],
    "net_income": [
        ("us-gaap", "NetIncomeLoss"),
        ("us-gaap", "ProfitLoss"),
        ("us-gaap", "NetIncomeLossAvailableToCommonStockholdersBasic"),
        ("ifrs-full", "ProfitLoss"),
        ("ifrs-full", "ProfitLossAttributableToOwnersOfParent"),
    ],
}
#: Units in order of preference; digits kept; the first day of history; days of a quarter.
UNITS = {
    "eps": ["USD/shares", "USD / shares", "USD/share", "USD / share", "pure"],
    "net_income": ["USD", "TWD", "JPY", "EUR", "CNY", "HKD", "CAD", "GBP", "KRW", "INR", "pure"],
}
DIGITS = {"eps": 6, "net_income": 3}
HISTORY_START, QUARTER_DAYS = "2000-01-01", (40, 140)


def preferred_unit(units: Column, figure: str) -> Column:
    """The rows of the first unit in order of preference, else of the document's first (for income: of the first that is not by share)."""
    known = [F.try_element_at(units, F.lit(u)) for u in UNITS[figure]]
    entries = F.map_entries(units)
    if figure == "net_income":
        known.append(F.get(F.filter(entries, lambda e: ~F.lower(e["key"]).contains("/share") & e["value"].isNotNull()), F.lit(0))["value"])
    known.append(F.get(F.filter(entries, lambda e: e["value"].isNotNull()), F.lit(0))["value"])
    return F.coalesce(*known)


def fact_rows(docs: DataFrame, key: str, text: str, figure: str) -> DataFrame:
    """Every dated entry of a figure's candidate measures: key, measure number, place, dates, value (null if not a number), frame and period."""
    doc = docs.select(key, F.from_json(text, DOCUMENT)["facts"].alias("__f"))
    rows = lambda t, m: preferred_unit(F.try_element_at(F.try_element_at(F.col("__f"), F.lit(t)), F.lit(m))["units"], figure)
    doc = doc.select(key, F.posexplode(F.array(*[rows(t, m) for t, m in MEASURES[figure]])).alias("measure_no", "__rows"))
    doc = doc.select(key, "measure_no", F.posexplode("__rows").alias("place", "__r"))
    value = round_half_up(finite(F.expr("try_cast(__r.val AS DOUBLE)")), DIGITS[figure])
    upper = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    out = doc.select(
        key, "measure_no", "place", text_date(F.col("__r.end")).alias("date"), text_date(F.col("__r.start")).alias("start"), text_date(F.col("__r.filed")).alias("filed"),
        value.alias("value"), upper(F.col("__r.frame")).alias("frame"), upper(F.col("__r.fp")).alias("fp"),
    )
    return out.where(F.col("date").isNotNull() & (F.col("date") >= F.lit(HISTORY_START).cast("date")))


def quarterly_facts(docs: DataFrame, key: str, text: str, figure: str) -> DataFrame:
    """(key, date, value, available, measure): one row a quarter, all from the candidate measure that has most quarters.

    Only entries of a quarter count (by frame, else by fiscal period). For one end date the entry over a
    quarter's days goes first, then the latest filed, then the smaller one, then the first in the document.
    At equal numbers of quarters the earlier candidate wins, however late the other was filed. Documents
    that cannot be read, and entries without a date or number, give nothing.
    """
    days = F.datediff("date", "start")
    rows = fact_rows(docs, key, text, figure).where("value IS NOT NULL").where(F.col("frame").rlike("Q[1-4]$") | F.col("fp").isin("Q1", "Q2", "Q3", "Q4"))
    rows = rows.withColumn("__quarter", F.coalesce(days.between(*QUARTER_DAYS), F.lit(False)))
    one = keep_best(rows, [key, "measure_no", "date"], F.desc("__quarter"), F.desc_nulls_last("filed"), F.abs(F.col("value")), F.col("place"))
    sizes = one.groupBy(key, "measure_no").agg(F.count(F.lit(1)).alias("__n"))
    best = sizes.groupBy(key).agg(F.max_by("measure_no", F.struct("__n", -F.col("measure_no"))).alias("measure_no"))
    names = F.array(*[F.lit(f"{t}:{m}") for t, m in MEASURES[figure]])
    out = one.join(best, [key, "measure_no"])
    return out.select(key, "date", "value", F.greatest("date", F.coalesce("filed", "date")).alias("available"), F.get(names, F.col("measure_no")).alias("measure"))


def first_available(docs: DataFrame, key: str, text: str, figure: str = "eps") -> DataFrame:
    """(key, quarter, available): when each quarter was first out, over all candidate measures, annual reports included."""
    rows = fact_rows(docs, key, text, figure)
    period = F.col("frame").rlike("Q[1-4]$") | F.col("frame").rlike("^CY[0-9]{4}$") | F.col("fp").isin("Q1", "Q2", "Q3", "Q4", "FY")
    out = rows.where(period).withColumn("__at", F.greatest("date", F.coalesce("filed", "date")))
    return out.groupBy(key, quarter_key(F.col("date")).alias("quarter")).agg(F.min("__at").alias("available"))
