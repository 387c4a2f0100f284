"""Daily valuation series put together from closes and sparse ratio anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.dates import subtract_years
from tidemark.functions.numbers import clamp, finite, round_half_up
from tidemark.operators.asof import asof_join
from tidemark.operators.merge import coalesce_outer
from tidemark.operators.timeseries import drop_spikes

RATIOS = ["pe_ttm", "pe_forward", "pb", "peg"]
#: The anchor of a series without any, the bound of every ratio, the least size of a usable number.
DEFAULTS = {"pe_ttm": 20.0, "pb": 3.0}
MOST, TINY = 1_000_000.0, 1e-8


def usable(c: Column) -> Column:
    """Finite and not zero, else null; the sign is kept."""
    v = finite(c)
    return F.when(F.abs(v) >= TINY, v)


def _bounded(c: Column, most: float = MOST) -> Column:
    return round_half_up(clamp(c, -most, most), 4)


def unify_anchors(closes: DataFrame, ratios: DataFrame, latest: DataFrame, entity: str = "entity", date: str = "d") -> DataFrame:
    """Anchors on trading days: each ratio from the earliest row that falls on the day, at the last close also from ``latest``.

    Rows on other days move to the next close; rows outside the closes go. ``latest`` has one row an entity.
    """
    span = closes.groupBy(entity).agg(F.min(date).alias("__first"), F.max(date).alias("__last"))
    inside = ratios.join(span, entity).where(F.col(date).between(F.col("__first"), F.col("__last"))).select(entity, date, *RATIOS)
    moved = asof_join(inside, closes.select(entity, F.col(date).alias("__day")), entity, date, "__day", [], direction="forward")
    earliest = lambda m: F.min(F.when(usable(F.col(m)).isNotNull(), F.struct(F.col(date), usable(F.col(m)).alias("v"))))["v"].alias(m)
    by_day = moved.groupBy(entity, F.col("asof_date").alias("__day")).agg(*[earliest(m) for m in RATIOS]).withColumnRenamed("__day", date)
    last = latest.join(span, entity).select(entity, F.col("__last").alias(date), *[usable(F.col(m)).alias(m) for m in RATIOS])
    return coalesce_outer(by_day, last, [entity, date], RATIOS).where(F.coalesce(*RATIOS).isNotNull())


def project_ratio(df: DataFrame, anchor: str, out: str, entity: str = "entity", date: str = "d", close: str = "close", most: float = MOST) -> DataFrame:
    """A ratio on every day from its anchors (null elsewhere).

    Between anchors of one sign it moves with the close, with an even drift of logs that meets the right one.
    Where the sign changes, and after the last anchor, it is the close over the left anchor's denominator.
    Null before the first anchor.
    """
    w = W.partitionBy(entity).orderBy(date)
    before = F.lag(close).over(w)
    ratio = F.col(close) / F.when(before != 0, before)
    df = df.withColumns({"__i": F.row_number().over(w), "__step": F.when(ratio > 0, F.log(ratio)).otherwise(0.0), "__den": F.col(close) / F.col(anchor)})
    df = df.withColumn("__sum", F.sum("__step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    known = F.when(F.abs("__den") >= TINY, F.struct(F.col("__i").alias("i"), F.col("__sum").alias("s"), F.col(anchor).alias("v"), F.col("__den").alias("den")))
    df = df.withColumn("__known", known)
    # The next anchor is the last one seen from the end: a growing frame, where a shrinking one is quadratic in Spark.
    ahead = W.partitionBy(entity).orderBy(F.desc(date)).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({"__l": F.last("__known", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "__r": F.last("__known", True).over(ahead)})
    left, right = F.col("__l"), F.col("__r")
    drift = (F.log(F.abs(right["v"] / left["v"])) - (right["s"] - left["s"])) / (right["i"] - left["i"])
    path = F.signum(left["v"]) * F.exp(F.log(F.abs(left["v"])) + F.col("__sum") - left["s"] + drift * (F.col("__i") - left["i"]))
    path = F.when(F.col("__i") == left["i"], left["v"]).otherwise(path)
    least = F.signum(left["den"]) * F.greatest(F.abs(left["den"]), F.lit(1e-6))
    value = F.when(left["v"] * right["v"] > 0, path).otherwise(F.col(close) / least)
    return df.withColumn(out, _bounded(value, most)).drop("__i", "__step", "__den", "__sum", "__known", "__l", "__r")


def _peg(pe: Column, growth: Column) -> Column:
    """Earnings ratio over growth in percent, null without growth."""
    return _bounded(pe / F.when(F.abs(growth) > TINY, growth * 100))


def valuation_series(closes: DataFrame, ratios: DataFrame, latest: DataFrame, entity: str = "entity", date: str = "d", close: str = "close") -> DataFrame:
    """Closes with the four ratios on every day, when forward values start, and whether a default anchor was needed.

    Trailing and book ratios of a series without anchors start from ``DEFAULTS`` at its first close; forward ones
    stay null. The growth ratio is the last anchor's, else from the forward ratio, else from implied earnings on
    those a year before. Short pulses of the forward ratio go. Days before the first trailing or book anchor are left out.
    """
    own = W.partitionBy(entity)
    df = closes.select(entity, date, F.col(close).cast("double").alias(close)).join(unify_anchors(closes, ratios, latest, entity, date), [entity, date], "left")
    first = F.col(date) == F.min(date).over(own)
    none = {m: F.count(F.when(F.abs(F.col(close) / F.col(m)) >= TINY, 1)).over(own) == 0 for m in DEFAULTS}
    df = df.withColumns(
        {f"__none_{m}": c for m, c in none.items()} | {"__day1": first, "forward_start": F.min(F.when(F.col("pe_forward").isNotNull(), F.col(date))).over(own)}
    )
    df = df.withColumns({m: F.when(F.col(f"__none_{m}") & F.col("__day1"), F.lit(v)).otherwise(F.col(m)) for m, v in DEFAULTS.items()})
    for m in ("pe_ttm", "pe_forward", "pb"):
        df = project_ratio(df, m, m, entity, date, close)
    df = df.withColumn("peg", _bounded(F.last("peg", True).over(own.orderBy(date).rowsBetween(W.unboundedPreceding, 0))))
    df = df.withColumn("__eps", F.when(F.col(close) > 0, F.col(close) / F.when(F.abs("pe_ttm") > TINY, F.col("pe_ttm"))))
    then = df.select(entity, F.col(date).alias("__then"), F.col("__eps").alias("__old"))
    df = asof_join(df.withColumn("__year_ago", subtract_years(F.col(date), 1)), then, entity, "__year_ago", "__then", ["__old"])
    by_forward = _peg(F.col("pe_ttm"), F.col("pe_ttm") / F.when(F.abs("pe_forward") > TINY, F.col("pe_forward")) - 1)
    by_earnings = _peg(F.col("pe_ttm"), F.col("__eps") / F.when(F.abs("__old") > TINY, F.col("__old")) - 1)
    df = df.where("pe_ttm is not null and pb is not null").withColumn("peg", F.coalesce("peg", by_forward, by_earnings))
    df = df.select(entity, date, close, *RATIOS, "forward_start", (F.col("__none_pe_ttm") | F.col("__none_pb")).alias("used_fallback"))
    return drop_spikes(df, entity, date, "pe_forward", fold=1.8, calm=1.32, widest=7)


#: Which of the trusted sources (trailing, forward, snapshots) tell from when on each ratio is trusted.
CUTS = {"pe_ttm": (1, 3), "pe_forward": (2, 3), "pb": (3,), "peg": (3,)}


def cutovers(trailing: DataFrame, forward: DataFrame, snapshots: DataFrame, entity: str = "entity", date: str = "d") -> tuple[DataFrame, DataFrame]:
    """Trusted rows with their source's number, and each entity's first trusted day of each ratio."""
    frames = [f.select(entity, date, *[usable(F.col(m)).alias(m) for m in RATIOS], F.lit(k).alias("__source")) for k, f in enumerate([trailing, forward, snapshots], 1)]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2])
    first = [F.min(F.when(F.col(m).isNotNull() & F.col("__source").isin(*CUTS[m]), F.col(date))).alias(f"__cut_{m}") for m in RATIOS]
    return rows, rows.groupBy(entity).agg(*first)


def merge_at_cutover(base: DataFrame, trailing: DataFrame, forward: DataFrame, snapshots: DataFrame, entity: str = "entity", date: str = "d") -> DataFrame:
    """Base rows keep each ratio only before its cut-over; on a day it comes from the base, then the sources in their order."""
    rows, cuts = cutovers(trailing, forward, snapshots, entity, date)
    early = base.join(cuts, entity, "left")
    open_ = {m: F.col(f"__cut_{m}").isNull() | (F.col(date) < F.col(f"__cut_{m}")) for m in RATIOS}
    early = early.select(entity, date, *[F.when(open_[m], usable(F.col(m))).alias(m) for m in RATIOS], F.lit(0).alias("__source"))
    pick = lambda m: F.min(F.when(F.col(m).isNotNull(), F.struct("__source", m)))[m].alias(m)
    return early.unionByName(rows).groupBy(entity, date).agg(*[pick(m) for m in RATIOS]).where(F.coalesce(*RATIOS).isNotNull())


def latest_at_cutover(latest: DataFrame, cuts: DataFrame, entity: str = "entity") -> DataFrame:
    """The base's latest ratios, null for those with a cut-over: trusted rows give them."""
    return latest.join(cuts, entity, "left").select(entity, *[F.when(F.col(f"__cut_{m}").isNull(), usable(F.col(m))).alias(m) for m in RATIOS])
