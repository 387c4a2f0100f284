"""A daily series drawn to sparse anchors by a scale that is interpolated between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.numbers import clamp, finite, round_half_up
from tidemark.operators.asof import asof_join
from tidemark.operators.merge import keep_best


@dataclass(frozen=True)
class Limits:
    """Bounds of the values, the widest gap between anchors, how far the ends reach, bounds of the scale."""

    low: float
    high: float
    span: int
    forward: int
    back: int
    least: float
    most: float


#: The usual limits of the trailing and the forward ratio.
TRAILING = Limits(2.4, 240.0, 180, 35, 35, 0.7, 1.4)
FORWARD = Limits(2.0, 120.0, 120, 20, 20, 0.65, 1.45)


def anchor_scales(points: DataFrame, anchors: DataFrame, value: str, limits: Limits, entity: str = "entity", date: str = "d") -> DataFrame:
    """(entity, at, scale, next_at, next_scale): each anchor over the series at its day, within bounds, with the anchor after it.

    Anchors out of range go; of one day the last in order of ``seq`` (if there is one) counts. The series is
    interpolated by days between its positive values and flat beyond them; anchors of entities without
    positive values have no scale.
    """
    good = anchors.where(F.col("value").between(limits.low, limits.high) & F.col(date).isNotNull())
    order = F.desc("seq") if "seq" in anchors.columns else F.desc("value")
    good = keep_best(good, [entity, date], order).select(entity, F.col(date).alias("at"), F.col("value").alias("anchor"))
    rows = points.where((finite(F.col(value)) > 0)).select(entity, F.col(date).alias("__day"), F.col(value).cast("double").alias("__v"))
    near = asof_join(good, rows, entity, "at", "__day", ["__day", "__v"]).drop("asof_date").withColumnsRenamed({"__day": "__d0", "__v": "__v0"})
    near = asof_join(near, rows, entity, "at", "__day", ["__day", "__v"], direction="forward").drop("asof_date")
    span = F.datediff("__day", "__d0")
    inside = F.col("__v0") + (F.col("__v") - F.col("__v0")) * F.datediff("at", "__d0") / span
    base = F.when(F.col("__d0").isNull(), F.col("__v")).when(F.col("__day").isNull() | (span == 0), F.col("__v0")).otherwise(inside)
    near = near.withColumn("scale", clamp(F.col("anchor") / F.when(base > 0, base), limits.least, limits.most))
    w = W.partitionBy(entity).orderBy("at")
    return near.select(entity, "at", "scale", F.lead("at").over(w).alias("next_at"), F.lead("scale").over(w).alias("next_scale"), (F.row_number().over(w) == 1).alias("first"))


def anchored_override(points: DataFrame, anchors: DataFrame, value: str, limits: Limits, entity: str = "entity", date: str = "d") -> DataFrame:
    """``points`` with ``value`` times the scale of its anchors (entity, date, value).

    A day takes the scale between the anchor before it and the next one at or after it, linear by days, if they
    are at most ``span`` days apart; before the first and after the last anchor that one's scale, for ``back``
    and ``forward`` days; else its own value. All positive values of an entity with anchors are kept within
    bounds; others, and entities without anchors, stay as they are.
    """
    scales = anchor_scales(points, anchors, value, limits, entity, date)
    # The anchor strictly before a day; on or before the first anchor it is the first.
    rows = points.withColumn("__eve", F.date_sub(date, 1))
    df = asof_join(rows, scales, entity, "__eve", "at", ["at", "scale", "next_at", "next_scale", "first"], before_first="first").drop("asof_date", "__eve")
    day, base = F.col(date), F.col(value).cast("double")
    along = F.datediff(day, "at") / F.datediff("next_at", "at")
    between = F.when(F.datediff("next_at", "at") <= limits.span, F.col("scale") + (F.col("next_scale") - F.col("scale")) * along)
    scale = (
        F.when(day < F.col("at"), F.when(F.datediff("at", day) <= limits.back, F.col("scale")))
        .when(F.col("next_at").isNull(), F.when((F.datediff(day, "at") <= limits.forward) | (day == F.col("at")), F.col("scale")))
        .otherwise(between)
    )
    moved = clamp(base * F.coalesce(scale, F.lit(1.0)), limits.low, limits.high)
    use = F.col("at").isNotNull() & (finite(base) > 0)
    return df.withColumn(value, F.when(F.coalesce(use, F.lit(False)), moved).otherwise(F.col(value))).select(*points.columns)


def monthly_overrides(points: DataFrame, trailing: DataFrame, forward: DataFrame, trailing_limits: Limits = TRAILING, forward_limits: Limits = FORWARD, entity: str = "entity", date: str = "d") -> DataFrame:
    """Points with both earnings ratios drawn to their monthly anchors and rounded to 4 digits."""
    df = anchored_override(points, trailing, "pe_ttm", trailing_limits, entity, date)
    df = anchored_override(df, forward, "pe_forward", forward_limits, entity, date)
    return df.withColumns({m: round_half_up(F.col(m), 4) for m in ("pe_ttm", "pe_forward")})
