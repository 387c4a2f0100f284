"""One function per route of the serving surface; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.numbers import earnings_yield
from tidemark.operators import alerts as al
from tidemark.operators import stats

#: Metrics that a series can be asked for.
METRICS = ("pe_ttm", "pe_forward", "pb", "earnings_yield")


def meta(points: DataFrame, dim: DataFrame) -> DataFrame:
    """The catalogue with each entity's range and number of points; entities without points have zero."""
    span = points.groupBy("entity").agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.count(F.lit(1)).alias("n_points"))
    return dim.join(span, "entity", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0).cast("long")))


def snapshot(points: DataFrame, dim: DataFrame, group: str | None = None) -> DataFrame:
    return stats.snapshot(points, dim, group)


def heatmap(points: DataFrame, dim: DataFrame, group: str | None = None) -> DataFrame:
    rows = stats.snapshot(points, dim, group)
    return rows.select("entity", "group", "display_name", "pe_ttm", "percentile_full", "regime", "position").orderBy("position")


def series(points: DataFrame, entity: str, metric: str, start: str | None = None, end: str | None = None, frame: str = "rows") -> DataFrame:
    """One entity's metric series; raises on an unknown metric, is empty for an unknown entity."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    one = points.where(F.col("entity") == entity)
    return stats.metric_series(stats.enrich_series(one) if metric == "earnings_yield" else one, metric, start, end, frame)


def company_snapshot(points: DataFrame, dim: DataFrame) -> DataFrame:
    """Each company's latest values and ranks by calendar years, numbered by market value, rank and name; missing ranks are 9999."""
    last = stats.latest_row(points).select("entity", F.col("d").alias("date"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pe_ttm", "pe_forward", "pb")], earnings_yield(F.col("pe_ttm"), signed=True).alias("earnings_yield"))
    ranks = stats.latest_stats(points).select("entity", "percentile_5y", "percentile_10y", "percentile_full", "z_score_3y", "change_1y", "regime")
    names = dim.withColumns({"rank": F.coalesce("rank", F.lit(9999)).cast("long"), "market_cap": F.coalesce("market_cap", F.lit(0))})
    df = last.join(ranks, "entity").join(names, "entity")
    # One row a company: the list is short.
    place = F.row_number().over(W.orderBy(F.desc("market_cap"), "rank", "display_name"))
    return df.withColumn("place", place.cast("long"))


def watchlists(lists: DataFrame, catalogue: list[str]) -> DataFrame:
    return al.normalize_watchlist(lists, catalogue)


def alerts(store: DataFrame, user: str) -> DataFrame:
    return store.where(F.col("user_id") == user).orderBy(F.desc("d"), "alert_id")


def acknowledge(store: DataFrame, user: str, ids: list[str] | None = None) -> DataFrame:
    return al.acknowledge(store, user, ids)


def daily_update(ranked: DataFrame, watchers: DataFrame, state: DataFrame, percentile: str = "percentile") -> tuple[DataFrame, DataFrame]:
    """One run over series with percentiles: (new alerts, alert state after the run); see ``latest_alerts``."""
    return al.latest_alerts(ranked, watchers, state, percentile)
