"""Enriched series, metric series, snapshots, heatmaps and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.dates import subtract_years
from tidemark.functions.numbers import clamp, earnings_yield, metric_rank_key, regime, valuation_rank_key
from tidemark.operators.windows import TRADING_DAYS, framed_ranks, row_frame, z_score


def enrich_series(points: DataFrame, entity: str = "entity", date: str = "d") -> DataFrame:
    """Adds percentiles over 5 and 10 years of rows and all rows, a 3-year z-score, yields and the regime.

    Percentiles rank by the negative-aware key, the z-score is of the raw ratio.
    """
    df = points.withColumn("__key", valuation_rank_key(F.col("pe_ttm")))
    ey = earnings_yield(F.col("pe_ttm"))
    df = df.withColumns(
        {
            "earnings_yield": ey,
            "erp_proxy": clamp(ey - F.col("us10y_yield"), -1, 1),
            "z_score_3y": z_score("pe_ttm", row_frame(entity, date, 3 * TRADING_DAYS)),
        }
    )
    df = framed_ranks(df, entity, date, "__key", {"percentile_5y": 5 * TRADING_DAYS, "percentile_10y": 10 * TRADING_DAYS, "percentile_full": None})
    return df.withColumn("regime", regime(F.col("percentile_full"))).drop("__key")


def metric_series(points: DataFrame, metric: str, start: str | None = None, end: str | None = None, frame: str = "rows", entity: str = "entity", date: str = "d") -> DataFrame:
    """One metric with its percentiles among the rows of the range only: the range is cut first."""
    df = points
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    df = df.select(entity, date, F.col(metric).alias("value"), metric_rank_key(metric, F.col(metric)).alias("__key"))
    if frame == "rows":
        df = framed_ranks(df, entity, date, "__key", {"percentile_5y": 5 * TRADING_DAYS, "percentile_10y": 10 * TRADING_DAYS, "percentile_full": None})
    else:
        df = framed_ranks(df, entity, date, "__key", {"percentile_full": None}, {f"percentile_{y}y": y for y in (5, 10)})
    return df.withColumn("regime", regime(F.col("percentile_full"))).drop("__key")


def latest_row(df: DataFrame, entity: str = "entity", date: str = "d") -> DataFrame:
    """The last row of each entity, by one aggregation."""
    rest = [c for c in df.columns if c != entity]
    return df.groupBy(entity).agg(F.max_by(F.struct(*rest), F.col(date)).alias("__r")).select(entity, "__r.*")


def latest_stats(points: DataFrame, value: str = "pe_ttm", signed: bool = True, basis: str = "percentile_10y", entity: str = "entity", date: str = "d") -> DataFrame:
    """The latest value ranked within its last 3, 5 and 10 calendar years and all years, and its change over a year.

    Only the last row's ranks are asked for, so one pass of conditional counts does, without windows.
    """
    key = valuation_rank_key(F.col(value)) if signed else F.col(value)
    df = points.where(F.col(value).isNotNull()).select(entity, date, F.col(value).alias("__v"), key.alias("__k"))
    last = df.groupBy(entity).agg(F.max(date).alias("__d"), F.max_by("__v", date).alias("__lv"), F.max_by("__k", date).alias("__lk"), F.count(F.lit(1)).alias("n_points"))
    df = df.join(last, entity)
    cut = lambda y: subtract_years(F.col("__d"), y)
    share = lambda test: F.count_if(test & (F.col("__k") <= F.col("__lk"))) / F.count_if(test)
    year = cut(1)
    ref = F.coalesce(F.max_by(F.col("__v"), F.when(F.col(date) <= year, F.col(date))), F.min_by(F.col("__v"), F.when(F.col(date) >= year, F.col(date))))
    three = F.when(F.col(date) >= cut(3), F.col("__v"))
    out = df.groupBy(entity).agg(
        F.first("__d").alias("last_date"),
        F.first("__lv").alias("last_value"),
        F.first("n_points").alias("n_points"),
        share(F.lit(True)).alias("percentile_full"),
        share(F.col(date) >= cut(10)).alias("percentile_10y"),
        share(F.col(date) >= cut(5)).alias("percentile_5y"),
        share(F.col(date) >= cut(3)).alias("percentile_3y"),
        F.avg(three).alias("__m"),
        F.coalesce(F.stddev_samp(three), F.lit(0.0)).alias("__s"),
        ref.alias("__ref"),
    )
    z = F.when(F.col("__s") > 1e-12, (F.col("last_value") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return out.withColumns({"z_score_3y": z, "change_1y": relative_change(F.col("last_value"), F.col("__ref")), "regime": regime(F.col(basis))}).drop("__m", "__s", "__ref")


def relative_change(now: Column, before: Column) -> Column:
    """Change by the size of the value before, so that a rise from a loss is positive; 0 without a usable value."""
    return F.coalesce(F.when(F.abs(before) > 1e-12, (now - before) / F.abs(before)), F.lit(0.0))


def latest_row_stats(
    points: DataFrame, value: str = "pe_ttm", signed: bool = False, years: tuple[int, ...] = (5, 10), reference: str = "date", entity: str = "entity", date: str = "d"
) -> DataFrame:
    """The latest value ranked within its last ``years`` times 252 rows and all rows, its z-score in 756 rows and its change.

    The change is on the last row a calendar year before or, with ``reference`` = "rows", on the row 251 rows
    before; the first row where there is none. Rows without a value are left out.
    """
    key = valuation_rank_key(F.col(value)) if signed else F.col(value)
    w = W.partitionBy(entity).orderBy(F.desc(date))
    df = points.where(F.col(value).isNotNull() & ~F.isnan(value)).select(entity, date, F.col(value).alias("__v"), key.alias("__k"))
    df = df.withColumns({"__n": F.row_number().over(w), "__lk": F.first("__k").over(w), "__d": F.first(date).over(w)})
    inside = lambda rows: F.lit(True) if rows is None else F.col("__n") <= rows
    share = lambda rows: F.count_if(inside(rows) & (F.col("__k") <= F.col("__lk"))) / F.count_if(inside(rows))
    three = F.when(inside(3 * TRADING_DAYS), F.col("__v"))
    old = F.col("__n") >= TRADING_DAYS if reference == "rows" else F.col(date) <= subtract_years(F.col("__d"), 1)
    out = df.groupBy(entity).agg(
        F.max("__d").alias("last_date"),
        F.max_by("__v", date).alias("last_value"),
        F.count(F.lit(1)).alias("n_points"),
        *[share(y * TRADING_DAYS).alias(f"percentile_{y}y") for y in years],
        share(None).alias("percentile_full"),
        F.avg(three).alias("__m"),
        F.coalesce(F.stddev_samp(three), F.lit(0.0)).alias("__s"),
        F.coalesce(F.max_by("__v", F.when(old, F.col(date))), F.min_by("__v", date)).alias("__ref"),
    )
    z = F.when(F.col("__s") > 0, (F.col("last_value") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    change = relative_change(F.col("last_value"), F.col("__ref"))
    return out.withColumns({"z_score_3y": z, "change_1y": change, "regime": regime(F.col("percentile_full"))}).drop("__m", "__s", "__ref")


def view_summary(df: DataFrame, value: str, entity: str = "entity", date: str = "d") -> DataFrame:
    """Range, extremes, last value and per cent change from the first of each series in view; the change of a single row is 0."""
    first, last = F.min_by(value, date), F.max_by(value, date)
    base = F.when(first == 0, 1.0).otherwise(F.abs(first))
    change = F.when(F.count(F.lit(1)) > 1, (last - first) / base * 100).otherwise(0.0)
    return df.groupBy(entity).agg(F.min(date).alias("from_date"), F.max(date).alias("to_date"), F.min(value).alias("lowest"), F.max(value).alias("highest"), last.alias("last_value"), change.alias("change_percent"))


def compare_summary(df: DataFrame, percentile: str, entity: str = "entity", date: str = "d") -> DataFrame:
    """One row: the number of series, their common range and the median of their last percentiles."""
    each = df.groupBy(entity).agg(F.min(date).alias("__a"), F.max(date).alias("__b"), F.max_by(percentile, date).alias("__p"))
    return each.agg(F.count(F.lit(1)).alias("n_series"), F.max("__a").alias("from_date"), F.min("__b").alias("to_date"), F.median("__p").alias("median_percentile"))


def snapshot(points: DataFrame, dim: DataFrame, group: str | None = None, entity: str = "entity", date: str = "d") -> DataFrame:
    """The latest enriched row of each entity with its attributes; ``group`` filters only for core and sector.

    Only the last row's ranks are asked for, so they come from conditional counts over numbered rows. The
    dimension is a catalogue: it is broadcast by Spark's own size check, not by a hint.
    """
    dim = dim.where(F.col("group") == group) if group in ("core", "sector") else dim
    ey = earnings_yield(F.col("pe_ttm"))
    last = latest_row(points, entity, date).withColumns({"earnings_yield": ey, "erp_proxy": clamp(ey - F.col("us10y_yield"), -1, 1)})
    ranks = latest_row_stats(points, "pe_ttm", True, entity=entity, date=date)
    ranks = ranks.select(entity, "percentile_5y", "percentile_10y", "percentile_full", "z_score_3y", "regime")
    return last.join(ranks, entity).join(dim, entity).orderBy(F.desc("percentile_full"), entity)


def range_filter(df: DataFrame, years: int, least: int = 60, entity: str = "entity", date: str = "d") -> DataFrame:
    """The last years of each series, or the whole of a series of which fewer than ``least`` rows would be left."""
    w = W.partitionBy(entity)
    df = df.withColumn("__in", F.col(date) >= subtract_years(F.max(date).over(w), years))
    return df.withColumn("__n", F.count_if("__in").over(w)).where((F.col("__n") < least) | F.col("__in")).drop("__in", "__n")


def compare_aligned(df: DataFrame, value: str, entity: str = "entity", date: str = "d", least: int = 2) -> DataFrame:
    """Series cut to their common start, as per cent of their first value; series of fewer rows are left out."""
    bounds = df.groupBy(entity).agg(F.min(date).alias("__first")).agg(F.max("__first").alias("__start"))
    # One row: the common start.
    df = df.join(F.broadcast(bounds), F.col(date) >= F.col("__start")).drop("__start")
    w = W.partitionBy(entity)
    df = df.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= least).drop("__n")
    first = F.first(value).over(w.orderBy(date).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.select(entity, date, value, F.when(first != 0, F.col(value) / first * 100).alias("rebased"))


def cross_section(df: DataFrame, value: str, at: str, entity: str = "entity", date: str = "d") -> DataFrame:
    """Each series' value at a date or the last before it, or its first if it starts later."""
    t = F.lit(at).cast("date")
    back = F.col(date) <= t
    return df.groupBy(entity).agg(
        F.coalesce(F.max(F.when(back, F.col(date))), F.min(date)).alias("at"),
        F.coalesce(F.max_by(F.col(value), F.when(back, F.col(date))), F.min_by(value, date)).alias("value"),
    )


def downsample(df: DataFrame, points: int, entity: str = "entity", date: str = "d") -> DataFrame:
    """At most ``points`` rows of each series at even steps, the first and last among them."""
    w = W.partitionBy(entity)
    df = df.withColumns({"__i": F.row_number().over(w.orderBy(date)) - 1, "__n": F.count(F.lit(1)).over(w)})
    slot = F.floor(F.col("__i") * (points - 1) / (F.col("__n") - 1))
    before = F.floor((F.col("__i") - 1) * (points - 1) / (F.col("__n") - 1))
    return df.where((F.col("__n") <= points) | (F.col("__i") == 0) | (slot > before)).drop("__i", "__n")


def y_range(df: DataFrame, value: str, low_percent: float = 0, high_percent: float = 100, pad: float = 0.08, entity: str = "entity", date: str = "d") -> DataFrame:
    """Padded minimum and maximum over a positional slice of each series."""
    w = W.partitionBy(entity)
    df = df.withColumns({"__i": F.row_number().over(w.orderBy(date)) - 1, "__n": F.count(F.lit(1)).over(w)})
    at = lambda p: F.floor((F.col("__n") - 1) * p / 100)
    out = df.where(F.col("__i").between(at(low_percent), at(high_percent))).groupBy(entity).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    room = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * pad).otherwise(F.greatest(F.abs(F.col("hi")) * pad, F.lit(1.0)))
    return out.select(entity, (F.col("lo") - room).alias("y_min"), (F.col("hi") + room).alias("y_max"))


def attention_order(df: DataFrame, order: list[str], entity: str = "entity") -> DataFrame:
    """Rows numbered by a fixed list of entities, unknown ones last by name."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(entity))
    return df.withColumn("attention", F.when(at > 0, at).otherwise(999).cast("long")).orderBy("attention", entity)
