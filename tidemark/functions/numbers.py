"""Numeric hygiene and valuation scalars as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the negative-aware rank key.
NEGATIVE_BASE, NEGATIVE_EPSILON = 1_000_000.0, 1e-6


def finite(c: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def round_half_up(c: Column, digits: int = 4) -> Column:
    """Rounds halves towards plus infinity, also below zero."""
    scale = F.lit(10.0**digits)
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    """Null stays null: least and greatest alone would skip it."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def sanitize_ratio(c: Column, low: float, high: float, digits: int = 4) -> Column:
    """Finite values whose size lies within [low, high], rounded; everything else null. The sign is kept."""
    v = finite(c)
    return F.when(F.abs(v).between(low, high), round_half_up(v, digits))


def rounded(c: Column, digits: int = 6) -> Column:
    """Finite values rounded, such as earnings per share; anything else null."""
    return round_half_up(finite(c), digits)


def share_count(c: Column) -> Column:
    v = finite(c)
    return F.when(v > 0, round_half_up(v, 3))


def to_number(c: Column, fallback: float = 0.0) -> Column:
    """Text or number to a finite double; null counts as zero, the rest as ``fallback``."""
    return F.when(c.isNull(), 0.0).otherwise(F.coalesce(finite(c.cast("string").try_cast("double")), F.lit(fallback)))


def parse_number_text(c: Column) -> Column:
    """The first signed number in a text with thousands commas, currency signs or percent signs."""
    digits = F.regexp_extract(F.regexp_replace(c, "[,$%\\s]", ""), "-?[0-9]+(?:\\.[0-9]+)?", 0)
    return F.when(digits != "", digits).try_cast("double")


def valuation_rank_key(v: Column) -> Column:
    """Sorts losses above every profit; of two losses the smaller is the dearer."""
    return F.when(v >= 0, v).otherwise(NEGATIVE_BASE + 1 / F.greatest(F.abs(v), F.lit(NEGATIVE_EPSILON)))


def metric_rank_key(metric: str, v: Column) -> Column:
    return valuation_rank_key(v) if metric in ("pe_ttm", "pe_forward", "pb") else v


def regime(percentile: Column) -> Column:
    return F.when(percentile <= 0.15, "low").when(percentile >= 0.85, "high").otherwise("neutral")


def direction(percentile: Column, upper: float = 85, lower: float = 15) -> Column:
    return F.when(percentile >= upper / 100, "high").when(percentile <= lower / 100, "low").otherwise("neutral")


def crossing(previous: Column, current: Column, upper: float = 85, lower: float = 15) -> Column:
    """The direction entered between two percentiles, null if it stayed or ended neutral."""
    now = direction(current, upper, lower)
    return F.when((now != "neutral") & (now != direction(previous, upper, lower)), now)


def severity(percentile: Column) -> Column:
    return F.when((percentile >= 0.95) | (percentile <= 0.05), "P1").otherwise("P2")


def earnings_yield(pe: Column, signed: bool = False) -> Column:
    """1 / pe within [-1, 1]; zero for losses, or with ``signed`` negative for them."""
    usable = F.abs(pe) > 1e-12 if signed else pe > 0
    return clamp(F.when(usable, 1 / pe).otherwise(0.0), -1, 1)


def snap_to_anchor(c: Column, anchors: list[float], tolerance: float) -> Column:
    """The nearest anchor if it lies within a relative tolerance, else the value."""
    gaps = [F.abs(c / a - 1) for a in anchors]
    best = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    picked = reduce(lambda out, k: F.when(gaps[k] == best, anchors[k]).otherwise(out), range(len(anchors) - 1, -1, -1), F.lit(None).cast("double"))
    return F.when(best <= tolerance, picked).otherwise(c)


def compact_number(c: Column) -> Column:
    """1.23T, 4.56B, 7.89M or the plain number with two digits."""
    fmt = lambda x, unit: F.concat(F.format_string("%.2f", x), F.lit(unit))
    return F.when(F.abs(c) >= 1e12, fmt(c / 1e12, "T")).when(F.abs(c) >= 1e9, fmt(c / 1e9, "B")).when(F.abs(c) >= 1e6, fmt(c / 1e6, "M")).otherwise(fmt(c, ""))


def ratio_number(c: Column) -> Column:
    """A ratio as providers print it: commas, per cent signs and a trailing x are dropped; words for none give null."""
    text = F.trim(F.regexp_replace(c, "[,%xX]", ""))
    none = F.lower(text).isin("", "n/a", "na", "--", "-", "none")
    return finite(F.when(~none, text.try_cast("double")))
