"""Rows out of columnar payloads: literals in page scripts, and tables of places in data documents."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import ratio_date_key, text_date
from tidemark.functions.numbers import finite, ratio_number, round_half_up
from tidemark.operators.valuation import usable
from tidemark.session import ship_package
from tidemark.sources.parse import dereference

#: The names of each column in the providers' payloads, in order.
RATIO_KEYS = {"pe_ttm": ["pe"], "pe_forward": ["peForward", "forwardPE", "forwardPe"], "pb": ["pb"], "peg": ["pegRatio", "peg"]}
STATISTIC_IDS = {"pe_ttm": ["pe", "peratio"], "pe_forward": ["peforward", "forwardpe", "forwardperatio"], "pb": ["pb", "pbratio"], "peg": ["peg", "pegratio"]}
INCOME_KEYS = {
    "eps": ["epsdil", "epsDiluted", "epsBasic", "eps"],
    "net_income": ["netinc", "netIncome", "netIncomeLoss", "profitloss"],
    "shares": ["shareswadil", "sharesDiluted", "shareswa", "shares"],
}
INCOME_DIGITS = {"eps": 6, "net_income": 3, "shares": 3}
#: Strings in any quotes, with escapes, and the signs that nest or part.
TOKEN = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|([\[{(])|([\]})])|([,:])""", re.S)
CLOSES = {"[": "]", "{": "}", "(": ")"}


def balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; -1 if none does. Brackets inside strings do not count."""
    open_: list[str] = []
    for m in TOKEN.finditer(text, at):
        if m[2]:
            open_.append(CLOSES[m[2]])
        elif m[3]:
            if m[3] != open_.pop():
                return -1
            if not open_:
                return m.end()
    return -1


def literal_arrays(text: str | None, name: str) -> dict[str, str]:
    """The array properties of the object literal that a script gives ``name``: property to JSON text.

    Only its own properties count, not those of objects or arrays inside it. Arrays that are not JSON are
    left out; of a repeated property the first counts. A name inside a string gives no arrays and is passed over.
    """
    text = (text or "").replace("\n", " ")
    for found in re.finditer(rf"""(?<![\w$]){re.escape(name)}["']?\s*:\s*(?=\{{)""", text):
        stop = balanced(text, found.end())
        out = _properties(text, found.end() + 1, stop - 1) if stop > 0 else {}
        if out:
            return out
    return {}


def _properties(text: str, at: int, stop: int) -> dict[str, str]:
    """Properties of an object's inside: a name, a colon, a value up to the next comma outside all brackets."""
    out: dict[str, str] = {}
    key, begin = None, at
    while m := TOKEN.search(text, at, stop):
        at = m.end()
        if m[4] == ":" and key is None:
            key, begin = text[begin : m.start()].strip().strip("\"'"), m.end()
        elif m[4] == ",":
            key, begin = None, m.end()
        elif m[2]:
            at = balanced(text, m.start())
            if m[2] == "[" and key is not None and not text[begin : m.start()].strip():
                try:
                    out.setdefault(key, json.dumps(json.loads(text[m.start() : at])))
                except ValueError:
                    pass
    return out


def script_arrays(c: Column, name: str) -> Column:
    """``literal_arrays`` of a column, a batch of texts at a time."""
    return F.pandas_udf(lambda s: pd.Series([literal_arrays(t, name) for t in s]), "map<string,string>")(c)


def first_array(arrays: Column, names: list[str]) -> Column:
    """The first of several properties that has items, as strings."""
    each = [F.from_json(F.try_element_at(arrays, F.lit(n)), "array<string>") for n in names]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in each], F.array().cast("array<string>"))


def transposed(df: DataFrame, key: str, lead: Column, columns: dict[str, Column]) -> DataFrame:
    """Parallel arrays as rows (key, place, lead, columns), as many as the leading array has; short arrays give nulls, longer ones are cut."""
    rows = df.select(key, F.posexplode(lead).alias("place", "lead"), *[c.alias(f"__{n}") for n, c in columns.items()])
    return rows.select(key, "place", "lead", *[F.get(f"__{n}", F.col("place")).alias(n) for n in columns])


def script_ratios(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, date, ratios) and the latest (key, ratios) out of a page's ``financialData`` literal.

    The latest column is the one called TTM, else the first; the others are dated by a day or a year.
    """
    ship_package(docs.sparkSession)
    read = docs.select(key, script_arrays(F.col(text), "financialData").alias("__a"))
    rows = transposed(read, key, first_array(F.col("__a"), ["datekey"]), {m: first_array(F.col("__a"), names) for m, names in RATIO_KEYS.items()})
    number = lambda m: usable(F.expr(f"try_cast({m} AS DOUBLE)")).alias(m)
    rows = rows.select(key, "place", "lead", *[number(m) for m in RATIO_KEYS])
    ttm = (F.col("place") == 0) | (F.col("lead") == "TTM")
    latest = rows.where(ttm).groupBy(key).agg(F.max_by(F.struct(*RATIO_KEYS), "place").alias("__l")).select(key, "__l.*")
    anchors = rows.where(~ttm).withColumn("date", ratio_date_key(F.col("lead"))).where(F.col("date").isNotNull() & F.coalesce(*RATIO_KEYS).isNotNull())
    return anchors.select(key, "date", *RATIO_KEYS), latest


def data_root(text: Column) -> Column:
    """The document that a data file's third node stands for, as JSON."""
    return dereference(F.get_json_object(text, "$.nodes[2].data"))


def statistics_ratios(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ratios, redirect): each ratio from the first entry of its names that is a number; redirects give only their path."""
    ship_package(docs.sparkSession)
    to = F.when(F.lower(F.get_json_object(text, "$.type")) == "redirect", F.trim(F.coalesce(F.get_json_object(text, "$.location"), F.lit(""))))
    read = docs.select(key, to.alias("redirect"), F.from_json(F.get_json_object(F.when(to.isNull(), data_root(F.col(text))), "$.ratios.data"), "array<struct<id:string,hover:string,value:string>>").alias("__e"))
    value = lambda e: usable(ratio_number(F.coalesce(e["hover"], e["value"])))
    first = lambda ids: F.get(F.filter(F.transform(F.filter("__e", lambda e: F.lower(F.trim(e["id"])).isin(ids)), value), lambda x: x.isNotNull()), F.lit(0))
    out = read.select(key, *[first(ids).alias(m) for m, ids in STATISTIC_IDS.items()], "redirect")
    return out.where(F.coalesce(*STATISTIC_IDS).isNotNull() | F.col("redirect").isNotNull())


def income_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, figure, date, value) out of an income statement's parallel arrays; of two columns with one date the later counts.

    Each figure comes from the first of its names that is an array. Numbers keep 6 digits (earnings per
    share) or 3; share counts must be positive.
    """
    ship_package(docs.sparkSession)
    read = docs.select(key, F.from_json(F.get_json_object(data_root(F.col(text)), "$.financialData"), "map<string,string>").alias("__d"))
    pick = lambda names: F.from_json(F.coalesce(*[F.when(F.try_element_at("__d", F.lit(n)).startswith("["), F.try_element_at("__d", F.lit(n))) for n in names]), "array<string>")
    rows = transposed(read, key, pick(["datekey"]), {f: pick(names) for f, names in INCOME_KEYS.items()})
    number = lambda f: round_half_up(finite(F.expr(f"try_cast({f} AS DOUBLE)")), INCOME_DIGITS[f])
    values = F.array(*[F.struct(F.lit(f).alias("figure"), (F.when(number(f) > 0, number(f)) if f == "shares" else number(f)).alias("value")) for f in INCOME_KEYS])
    rows = rows.withColumn("date", text_date(F.col("lead"))).where("date IS NOT NULL").select(key, "place", "date", F.inline(values)).where("value IS NOT NULL")
    return rows.groupBy(key, "figure", "date").agg(F.max_by("value", "place").alias("value"))
