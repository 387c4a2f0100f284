"""Precedence unions, upserts and duplicates of keyed series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_best(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key: the first in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def priority_union(frames: list[DataFrame], keys: list[str], *ties) -> DataFrame:
    """Rows of all frames; of the same key the row of the earliest frame wins."""
    ranked = [f.withColumn("__rank", F.lit(i)) for i, f in enumerate(frames)]
    return keep_best(reduce(DataFrame.unionByName, ranked), keys, "__rank", *ties).drop("__rank")


def recent_override(base: DataFrame, overlay: DataFrame, key: str, date: str, days: int) -> DataFrame:
    """The overlay's rows from ``days`` before the base's last date on replace or extend the base; a key without base takes all."""
    last = base.groupBy(key).agg(F.max(date).alias("__last"))
    recent = overlay.join(last, key, "left").where(F.col("__last").isNull() | (F.datediff("__last", date) <= days)).drop("__last")
    return priority_union([recent, base], [key, date])


def coalesce_outer(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on the keys; each value from the left where it is not null."""
    r = right.select(*keys, *[F.col(v).alias(f"__r_{v}") for v in values])
    return left.select(*keys, *values).join(r, keys, "full").select(*keys, *[F.coalesce(v, f"__r_{v}").alias(v) for v in values])


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of the same key; null values leave what is stored."""
    return coalesce_outer(incoming, stored, keys, values)


def preserve_recorded(generated: DataFrame, previous: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Generated rows, and the previous rows of recorded keys that the generation left out."""
    kept = previous.join(recorded.select(*keys).distinct(), keys, "left_semi").join(generated.select(*keys), keys, "left_anti")
    return generated.unionByName(kept)


def override_on_date(points: DataFrame, snapshots: DataFrame, keys: list[str], digits: dict[str, int]) -> DataFrame:
    """Snapshot values, rounded, in place of the points' own on the same key."""
    from tidemark.functions.numbers import round_half_up

    s = snapshots.select(*keys, *[round_half_up(F.col(c), d).alias(f"__s_{c}") for c, d in digits.items()])
    out = points.join(s, keys, "left")
    return out.select(*[F.coalesce(f"__s_{c}", c).alias(c) if c in digits else F.col(c) for c in points.columns])


def toggle(ids: Column, one: Column) -> Column:
    """An array with one id removed if it is there, else appended."""
    return F.when(F.array_contains(ids, one), F.array_remove(ids, one)).otherwise(F.array_append(ids, one))


def first_sufficient(rows: DataFrame, key: str, source: str, least: int) -> DataFrame:
    """Each key's rows from its first source with ``least`` rows, or else from the one with most rows, the first on ties."""
    sizes = rows.groupBy(key, source).agg(F.count(F.lit(1)).alias("__n"))
    order = F.struct((F.col("__n") < least).alias("short"), F.when(F.col("__n") < least, -F.col("__n")).otherwise(0).alias("size"), F.col(source).alias("source"))
    best = sizes.groupBy(key).agg(F.min(order)["source"].alias(source))
    return rows.join(best, [key, source], "left_semi")


def cutover_merge(base: DataFrame, trusted: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Trusted rows, and the base's rows before the first trusted one of the same key."""
    cut = trusted.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(date).alias("__cut"))
    early = base.join(cut, key, "left").where(F.col("__cut").isNull() | (F.col(date) < F.col("__cut"))).drop("__cut")
    return coalesce_outer(trusted, early, [key, date], [value])


def lookup(rows: DataFrame, table: DataFrame, symbol: str, ticker: str, value: str) -> DataFrame:
    """Rows with the table's value for their symbol as it stands, or else without its punctuation; of several the smallest."""
    from tidemark.functions.text import ticker_key

    exact = table.groupBy(F.col(ticker).alias("__t")).agg(F.min(value).alias("__exact"))
    plain = table.groupBy(ticker_key(F.col(ticker)).alias("__k")).agg(F.min(value).alias("__plain"))
    out = rows.join(exact, F.col(symbol) == F.col("__t"), "left").join(plain, ticker_key(F.col(symbol)) == F.col("__k"), "left")
    return out.select(*rows.columns, F.coalesce("__exact", "__plain").alias(value))


def best_ranked(rows: DataFrame, key: str, rank: str, most: int) -> DataFrame:
    """The best rank of each key and how often it is listed, the first ``most`` by rank."""
    return rows.groupBy(key).agg(F.min(rank).alias(rank), F.count(F.lit(1)).alias("n")).orderBy(rank).limit(most)
