"""Threshold crossings with cooldown, alert stores and watchlists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.numbers import crossing, direction, severity
from tidemark.operators.windows import previous


def crossings(df: DataFrame, percentile: str, upper: float = 85, lower: float = 15, entity: str = "entity", date: str = "d") -> DataFrame:
    """Days on which a series enters the high or the low zone, also straight from the other."""
    df = df.withColumn("previous", previous(percentile, entity, date))
    df = df.withColumn("direction", crossing(F.col("previous"), F.col(percentile), upper, lower))
    return df.where(F.col("previous").isNotNull() & F.col("direction").isNotNull()).withColumn("severity", severity(F.col(percentile)))


def trading_days(df: DataFrame, date: str = "d") -> DataFrame:
    """Observed dates, numbered. A calendar: at most a few hundred rows a year, whatever the number of series."""
    return df.select(date).distinct().withColumn("day_no", F.row_number().over(W.orderBy(date)))


def with_cooldown(crossed: DataFrame, cooldown: int, entity: str = "entity", date: str = "d", day_no: str = "day_no") -> DataFrame:
    """Of a series' crossings those at least ``cooldown`` trading days after the last alert given.

    The rule looks back at alerts, not at crossings, so it is folded over each series in order.
    """
    from tidemark.session import ship_package

    ship_package(crossed.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(day_no)
        keep, last = [], None
        for i, no in enumerate(table.column(day_no).to_pylist()):
            if last is None or no - last >= cooldown:
                keep.append(i)
                last = no
        return table.take(pa.array(keep, pa.int64()))

    return crossed.groupBy(entity).applyInArrow(run, crossed.schema)


def latest_alerts(points: DataFrame, watchers: DataFrame, state: DataFrame, percentile: str, entity: str = "entity", date: str = "d", most: int = 500) -> tuple[DataFrame, DataFrame]:
    """One run of the daily update: the new alerts of each user's series, and the alert state after it.

    ``watchers`` has user_id, entity, upper, lower, cooldown; ``state`` user_id, entity, last_triggered,
    last_direction of the runs before. The last two percentiles of a series decide; an alert is held back
    until ``cooldown`` of the series' own dates have passed since the last. A last trigger that is not one
    of the series' dates, or lies after its end, holds nothing back. Series of one row are skipped.
    """
    w = W.partitionBy(entity).orderBy(date)
    rows = points.select(entity, date, F.col(percentile).alias("__p"), F.lag(percentile).over(w).alias("__before"), F.row_number().over(w).alias("__no"))
    last = rows.groupBy(entity).agg(F.max_by(F.struct(date, "__p", "__before", "__no"), date).alias("__l")).select(entity, "__l.*").where("__before is not null")
    known = state.join(rows.select(entity, F.col(date).alias("last_triggered"), F.col("__no").alias("__then")), [entity, "last_triggered"], "left")
    df = watchers.join(last, entity).join(known.select("user_id", entity, "last_triggered", "last_direction", "__then"), ["user_id", entity], "left")
    hit = crossing(F.col("__before"), F.col("__p"), F.col("upper"), F.col("lower"))
    held = (F.col("__no") - F.col("__then")).between(0, F.col("cooldown") - 1)
    df = df.withColumn("__hit", F.when(~F.coalesce(held, F.lit(False)), hit))
    fired = df.where("__hit is not null").select("user_id", entity, date, F.col("__hit").alias("direction"), severity(F.col("__p")).alias("severity"), F.col("__p").alias("percentile"))
    fired = fired.withColumn("alert_id", F.sha2(F.concat_ws("|", "user_id", entity, F.col(date).cast("string"), "direction"), 256))
    newest = W.partitionBy("user_id").orderBy(F.desc(date), "alert_id")
    fired = fired.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most).drop("__n")
    after = df.select(
        "user_id", entity, F.when(F.col("__hit").isNotNull(), F.col(date)).otherwise(F.col("last_triggered")).alias("last_triggered"),
        F.coalesce("__hit", direction(F.col("__p"), F.col("upper"), F.col("lower"))).alias("last_direction"),
    )
    untouched = state.join(after.select("user_id", entity), ["user_id", entity], "left_anti").select("user_id", entity, "last_triggered", "last_direction")
    return fired, after.unionByName(untouched)


def alert_rows(fired: DataFrame, watchers: DataFrame, percentile: str, entity: str = "entity", date: str = "d", most: int = 500) -> DataFrame:
    """One unread alert per watching user, with an id made of its keys; the newest ``most`` of each user."""
    df = watchers.join(fired, entity)
    df = df.select(
        F.sha2(F.concat_ws("|", "user_id", entity, F.col(date).cast("string"), "direction"), 256).alias("alert_id"),
        "user_id", entity, date, "direction", "severity", F.round(percentile, 4).alias("percentile"), F.lit(False).alias("read"),
    )
    w = W.partitionBy("user_id").orderBy(F.desc(date), "alert_id")
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def merge_alerts(stored: DataFrame, fired: DataFrame, date: str = "d", most: int = 500) -> DataFrame:
    """Stored and new alerts of each user, the newest ``most``; one that is stored already keeps its row and its ``read``."""
    new = fired.join(stored.select("alert_id"), "alert_id", "left_anti").withColumn("read", F.lit(False)).select(*stored.columns)
    w = W.partitionBy("user_id").orderBy(F.desc(date), "alert_id")
    return stored.unionByName(new).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def acknowledge(alerts: DataFrame, user: str, ids: list[str] | None = None) -> DataFrame:
    """Alerts of a user marked as read, all of them or those listed."""
    hit = F.col("user_id") == user
    if ids is not None:
        hit = hit & F.col("alert_id").isin(ids)
    return alerts.withColumn("read", F.col("read") | hit)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_alerts"), F.count_if(~F.col("read")).alias("n_unread"))


def normalize_watchlist(lists: DataFrame, catalogue: list[str], first: int = 6) -> DataFrame:
    """Known ids once each in order, or the catalogue's first ones if none is left; rules within bounds."""
    known = F.array(*[F.lit(x) for x in catalogue])
    ids = F.array_intersect(F.coalesce("watch_ids", F.array().cast("array<string>")), known)
    number = lambda c, low, high, default: F.least(F.greatest(F.coalesce(c, F.lit(default)), F.lit(low)), F.lit(high))
    return lists.select(
        "user_id",
        F.when(F.size(ids) > 0, ids).otherwise(F.slice(known, 1, first)).alias("watch_ids"),
        number(F.col("upper"), 50.0, 99.0, 85.0).alias("upper"),
        number(F.col("lower"), 1.0, 50.0, 15.0).alias("lower"),
        number(F.col("cooldown"), 0, 60, 5).cast("int").alias("cooldown"),
    )
