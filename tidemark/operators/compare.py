"""Several series side by side: ranges first, then ranks within them, then the common start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.dates import subtract_years
from tidemark.functions.numbers import earnings_yield, regime
from tidemark.operators.windows import TRADING_DAYS, framed_ranks, row_frame, z_score
from tidemark.session import cut_lineage

#: Rows that a range must leave, or the whole series stays; series shown at once; series if none is chosen.
LEAST_ROWS, MOST_SERIES, DEFAULT_SERIES = 60, 8, 4


def chosen(ids: list[str], watchlist: list[str]) -> list[str]:
    """The first eight ids chosen, or the first four of the watchlist."""
    return ids[:MOST_SERIES] or watchlist[:DEFAULT_SERIES]


def metric_rows(points: DataFrame, metric: str, starts: DataFrame | None = None, entity: str = "entity", date: str = "d") -> DataFrame:
    """(entity, date, value): finite values of a metric; forward ratios only from the entity's ``forward_start`` on, or its last date without one."""
    value = earnings_yield(F.col("pe_ttm")) if metric == "earnings_yield" else F.col(metric).cast("double")
    df = points.select(entity, date, value.alias("value"))
    if metric == "pe_forward" and starts is not None:
        last = points.groupBy(entity).agg(F.max(date).alias("__last"))
        df = df.join(last.join(starts.select(entity, "forward_start"), entity, "left"), entity)
        df = df.where(F.col(date) >= F.coalesce("forward_start", "__last")).drop("forward_start", "__last")
    return df.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def range_starts(rows: DataFrame, years: int | None, entity: str = "entity", date: str = "d") -> DataFrame:
    """(entity, first, last, from): each series' dates, and the first day of its last ``years``, null where these are under 60 rows."""
    ends = rows.groupBy(entity).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    if not years:
        return ends.withColumn("from", F.lit(None).cast("date"))
    day = subtract_years(F.col("last"), years)
    inside = rows.join(ends, entity).groupBy(entity, "first", "last").agg(F.count_if(F.col(date) >= day).alias("__n"))
    return inside.select(entity, "first", "last", F.when(F.col("__n") >= LEAST_ROWS, day).alias("from"))


def date_bounds(rows: DataFrame, years: int | None, entity: str = "entity", date: str = "d") -> DataFrame:
    """One row: the earliest first and the latest last date of the series, each cut to its range."""
    starts = range_starts(rows, years, entity, date)
    first = rows.join(starts, entity).where(F.col("from").isNull() | (F.col(date) >= F.col("from"))).groupBy(entity).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return first.agg(F.min("a").alias("min_date"), F.max("b").alias("max_date"))


def compare_rows(rows: DataFrame, ids: list[str], years: int | None, start: str | None = None, end: str | None = None, entity: str = "entity", date: str = "d") -> DataFrame:
    """Rows of the chosen series from their common start on, with ranks among the rows of their range.

    The first pass finds each series' range (its last years, cut to ``start`` and ``end``, which may come in
    either order) and the first date in it: one small row a series. The second reads the rows again with the
    ids and ranges as filters on the scan, ranks what is left, and only then drops the rows before the latest
    of the first dates, as ranks count them. Series of fewer than two rows, before or after, are left out.
    """
    if start and end and start > end:
        start, end = end, start
    mine = rows.where(F.col(entity).isin(ids))
    inside = mine
    if start:
        inside = inside.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        inside = inside.where(F.col(date) <= F.lit(end).cast("date"))
    starts = range_starts(mine, years, entity, date).select(entity, "from")
    in_range = F.col("from").isNull() | (F.col(date) >= F.col("from"))
    sizes = inside.join(starts, entity).where(in_range).groupBy(entity, "from").agg(F.min(date).alias("__first"), F.count(F.lit(1)).alias("__n"))
    sizes = cut_lineage(sizes.where("__n >= 2"))
    common = sizes.agg(F.max("__first")).head()[0]
    ranges = sizes.select(entity, "from")
    df = inside.join(ranges, entity, "inner").where(in_range).drop("from")
    df = df.withColumn("z_score_3y", z_score("value", row_frame(entity, date, 3 * TRADING_DAYS)))
    df = framed_ranks(df, entity, date, "value", {"percentile_5y": 5 * TRADING_DAYS, "percentile_10y": 10 * TRADING_DAYS, "percentile_full": None})
    df = df.withColumn("regime", regime(F.col("percentile_full"))).where(F.col(date) >= F.lit(common).cast("date"))
    return df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(entity))).where("__n >= 2").drop("__n")
