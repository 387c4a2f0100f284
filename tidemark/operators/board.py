"""Filtered and sorted boards of snapshot rows, and plausibility checks between metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import keyword_matches

#: Sort mode -> (column, descending, nulls last).
MODES = {
    "percentile_desc": ("percentile", True),
    "percentile_asc": ("percentile", False),
    "value_desc": ("value", True),
    "value_asc": ("value", False),
    "size_desc": ("size", True),
    "name": ("name", False),
    "pe_desc": ("pe_ttm", True),
    "pe_asc": ("pe_ttm", False),
    "pb_desc": ("pb", True),
    "pb_asc": ("pb", False),
    "peg_asc": ("peg", False),
    "market_cap_desc": ("market_cap", True),
}


def sort_keys(mode: str, entity: str = "entity") -> list[Column]:
    """Order of a mode, nulls last either way, ties by entity; unknown modes sort by name."""
    column, down = MODES.get(mode, MODES["name"])
    return [F.desc_nulls_last(column) if down else F.asc_nulls_last(column), F.col(entity)]


def board(rows: DataFrame, keyword: str = "", group: str | None = None, watch: list[str] | None = None, mode: str = "name", top: int | None = None, entity: str = "entity") -> DataFrame:
    """Rows of a group or watchlist that match a keyword, sorted; the first ``top`` unless a keyword is given."""
    df = rows.where(keyword_matches(keyword, F.col("name"), F.col(entity)))
    if group in ("core", "sector"):
        df = df.where(F.col("group") == group)
    if watch is not None:
        df = df.where(F.col(entity).isin(watch))
    df = df.orderBy(*sort_keys(mode, entity))
    return df.limit(top) if top and not keyword else df


def reasonable_pe(c: Column) -> Column:
    return F.coalesce((c > 4) & (c < 80), F.lit(False))


def reasonable_forward_pe(c: Column) -> Column:
    return F.coalesce((c > 2) & (c < 120), F.lit(False))


def plausible_pair(trailing: Column, forward: Column) -> Column:
    """Whether a forward ratio fits a trailing one: both reasonable, 0.45 to 0.95 of it and at least 0.8 below."""
    fits = (forward / F.when(trailing != 0, trailing)).between(0.45, 0.95) & (trailing - forward >= 0.8)
    return reasonable_pe(trailing) & reasonable_forward_pe(forward) & F.coalesce(fits, F.lit(False))


def acceptable_deviation(candidate: Column, baseline: Column, most: float = 0.05, reasonable=reasonable_pe) -> Column:
    """Whether a reasonable value departs from a baseline by at most a share of it; any does without a reasonable baseline."""
    near = F.abs(candidate - baseline) / F.greatest(F.lit(1e-6), baseline) <= most
    return reasonable(candidate) & (~reasonable(baseline) | F.coalesce(near, F.lit(False)))


def compatible(candidate: Column, reference: Column, fold: float = 3.2) -> Column:
    """Whether a value is within ``fold`` times of a reference of the same sign; true without a reference."""
    near = (candidate * reference > 0) & F.greatest(candidate / reference, reference / candidate).between(1, fold)
    return F.when(candidate.isNull(), False).when(reference.isNull() | (reference == 0), True).otherwise(near)


def recent_reference(refs: DataFrame, at: Column, max_age: int = 90, entity: str = "entity", date: str = "d", value: str = "v") -> DataFrame:
    """Each entity's last reference at or before a date, if it is at most ``max_age`` days old."""
    df = refs.where((F.col(date) <= at) & (F.datediff(at, F.col(date)) <= max_age))
    return df.groupBy(entity).agg(F.max(date).alias(date), F.max_by(value, date).alias(value))


def stale_entities(df: DataFrame, at: Column, max_lag: int = 50, entity: str = "entity", date: str = "d") -> DataFrame:
    """Entities with their lag in days at a date, and whether it is too long."""
    lag = F.datediff(at, F.max(date)).cast("long")
    return df.groupBy(entity).agg(lag.alias("lag_days"), (lag > max_lag).alias("stale"))


#: How wide a gap and how old an end the baseline of a latest value may have.
BASELINE_GAP, BASELINE_AGE = 240, 60


def accept_latest(series: DataFrame, candidates: DataFrame, most: float = 0.05, reasonable=reasonable_pe, entity: str = "entity", date: str = "d") -> DataFrame:
    """Candidates (entity, date, candidate) with their baseline and whether they are accepted.

    The baseline is the series (entity, date, value) at the candidate's day, linear between values at most 240
    days apart, flat for 60 days after the last. A candidate that is reasonable by itself is accepted if it
    departs from a reasonable baseline by at most ``most`` of it, or if there is no such baseline.
    """
    from tidemark.operators.timeseries import interpolate

    known = series.select(entity, date, F.col("value").cast("double").alias("value"))
    days = known.unionByName(candidates.select(entity, date, F.lit(None).cast("double").alias("value"))).groupBy(entity, date).agg(F.max("value").alias("value"))
    line = interpolate(days, entity, date, "value", "baseline", widest=BASELINE_GAP, before_first="null", fill=BASELINE_AGE)
    out = candidates.join(line.select(entity, date, "baseline"), [entity, date])
    return out.withColumn("accepted", acceptable_deviation(F.col("candidate"), F.col("baseline"), most, reasonable))
