"""Rows out of HTML, JSON and CSV texts, with built-in functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.dates import epoch_date, text_date
from tidemark.functions.numbers import parse_number_text
from tidemark.functions.text import strip_html


def csv_cells(line: Column) -> Column:
    """Cells of an unquoted CSV line, trimmed."""
    return F.transform(F.split(F.regexp_replace(line, "\r", ""), ","), lambda c: F.trim(c))


def csv_rows(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Non-blank lines of a CSV text with their numbers."""
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "").withColumn("cells", csv_cells(F.col("line"))).drop("line")


def table_rows(html: Column) -> Column:
    """Table rows as arrays of visible cell texts."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_html))


def ratio_pair(cells: Column) -> Column:
    """(trailing, forward) out of a row's cells: the first number of 4 to 120, and the least later one below it, or else the least later one."""
    found = F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0))))
    values = F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double")), lambda x: x.between(4, 120))
    first, later = F.get(values, F.lit(0)), F.slice(values, 2, 1000000)
    forward = F.coalesce(F.array_min(F.filter(later, lambda x: x < first)), F.array_min(later))
    return F.when(F.size(values) >= 2, F.struct(first.alias("trailing"), forward.alias("forward")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)href=\"([^\"]*)\""), F.lit(1))


def dated_values(df: DataFrame, html: str, keep: list[str], date_cell: int = 1, value_cell: int = 2, low: float = 0, high: float = 250) -> DataFrame:
    """(date, value) of table rows whose cells are a date and a number in range; the first of a date wins."""
    rows = df.select(*keep, F.posexplode(table_rows(F.col(html))).alias("row_no", "cells"))
    rows = rows.select(*keep, "row_no", text_date(F.get("cells", F.lit(date_cell - 1))).alias("date"), parse_number_text(F.get("cells", F.lit(value_cell - 1))).alias("value"))
    rows = rows.where(F.col("date").isNotNull() & (F.col("value") > low) & (F.col("value") <= high))
    w = W.partitionBy(*keep, "date").orderBy("row_no")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "row_no")


def chart_closes(json_text: Column) -> Column:
    """Chart documents with parallel arrays of epochs and closes, as an array of (date, close); nulls go."""
    doc = F.from_json(json_text, "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>")
    r = F.get(doc["chart"]["result"], F.lit(0))
    pairs = F.arrays_zip(r["timestamp"].alias("ts"), F.get(r["indicators"]["quote"], F.lit(0))["close"].alias("close"))
    return F.filter(F.transform(pairs, lambda p: F.struct(epoch_date(p["ts"]).alias("date"), p["close"].alias("close"))), lambda p: p["close"] > 0)


def epoch_pairs(json_text: Column) -> Column:
    """Arrays of [epoch, value] as an array of (date, value)."""
    pairs = F.from_json(json_text, "array<array<double>>")
    return F.filter(F.transform(pairs, lambda p: F.struct(epoch_date(F.get(p, F.lit(0))).alias("date"), F.get(p, F.lit(1)).alias("value"))), lambda p: p["value"].isNotNull())


def first_path(json_text: Column, *paths: str) -> Column:
    """The first of several JSON paths that has a value."""
    return F.coalesce(*[F.get_json_object(json_text, p) for p in paths])


def array_literal(text: Column, key: str) -> Column:
    """The array literal after a key in a script, as JSON strings."""
    return F.from_json(F.regexp_extract(text, rf"\b{key}\s*:\s*(\[[^\]]*\])", 1), "array<string>")


def running_date(df: DataFrame, text: str, keep: list[str], pattern: str = "(?i)as of ([0-9]{4}-[0-9]{2}-[0-9]{2})") -> DataFrame:
    """Lines of a text, each with the last date announced in or above it."""
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    said = F.regexp_extract("line", pattern, 1)
    w = W.partitionBy(*keep).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("as_of", F.last(F.when(said != "", F.to_date(said)), True).over(w))


def best_filing(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Of the filings for one period: quarterly durations first, then the latest filed, then the smallest value."""
    from tidemark.operators.merge import keep_best

    quarter = F.datediff("end", "start").between(60, 120)
    return keep_best(facts.withColumn("__q", F.coalesce(quarter, F.lit(False))), keys, F.desc("__q"), F.desc("filed"), F.abs(F.col("value"))).drop("__q")


def _dereference(table_json: str | None) -> str | None:
    if table_json is None:
        return None
    try:
        table = json.loads(table_json)
    except ValueError:
        return None
    done: dict[int, object] = {}

    def look(i: object, open_: tuple[int, ...] = ()) -> object:
        if not isinstance(i, int) or isinstance(i, bool) or not 0 <= i < len(table) or i in open_:
            return None
        if i not in done:
            v, path = table[i], (*open_, i)
            done[i] = [look(x, path) for x in v] if isinstance(v, list) else {k: look(x, path) for k, x in v.items()} if isinstance(v, dict) else v
        return done[i]

    return json.dumps(look(0)) if isinstance(table, list) and table else None


def dereference(c: Column) -> Column:
    """The document of an index-compressed JSON table: numbers stand for places in the table.

    Recursion is beyond column functions; cycles come out as null. For landed provider documents only.
    """
    return F.pandas_udf(lambda s: s.map(_dereference, na_action="ignore"), "string")(c)
