"""Crossing alerts with cooldown over a stream of percentiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Times are microseconds and hours are counted from 1970, 24 a date, so that no time zone plays a part in Python.
#: Zones are 1, 0, -1; ``before`` is the zone of the row before in the same hour, ``turn`` tells the rows that can matter.
MARKED = "entity string, at long, hour long, percentile double, zone byte, before byte, turn boolean"
OUT = "entity string, at long, percentile double, direction string, severity string"
STATE = "direction byte, fired long, seen long, hour long, day long"
#: ``before`` of an hour's first row.
START = 2
#: Time and hour of rows without a time.
NEVER, NO_HOUR = 2**63 - 1, 2**40
#: Tasks that the hours of all entities are dealt to, at least.
SPREAD = 64


def mark_turns(df: DataFrame, upper: float, lower: float, cooldown: int) -> DataFrame:
    """Rows of (entity, at, percentile), the first of a moment, with a mark on those that can matter to alerts.

    Tasks have some hours of each entity and put them in order. They mark the first and the last row of an
    hour and the first crossing between them, as a day has one alert at most; without a cooldown, all crossings.
    """
    tasks = max(SPREAD, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).sort_by([("entity", "ascending"), ("at", "ascending"), ("percentile", "ascending")])
        del batches
        changes = lambda t, c: np.r_[True, np.diff(t[c].to_numpy()) != 0]
        codes = t["entity"].combine_chunks().dictionary_encode().indices.fill_null(-1)
        other = np.r_[True, np.diff(codes.to_numpy(zero_copy_only=False)) != 0]
        once = other | changes(t, "at")
        first = other | changes(t, "hour")
        t, first = t.filter(pa.array(once)), first[once]
        p = t["percentile"].to_numpy()
        zone = (p >= upper).astype(np.int8) - (p <= lower)
        before = np.where(first, START, np.r_[START, zone[:-1]]).astype(np.int8)
        crossed = ~first & (zone != 0) & (zone != before)
        turn = first | np.r_[first[1:], True]
        at = np.flatnonzero(crossed)
        if cooldown > 0:
            at = at[np.unique(np.cumsum(first)[at], return_index=True)[1]]
        turn[at] = True
        for name, values in (("zone", zone), ("before", before), ("turn", turn)):
            t = t.append_column(name, pa.array(values))
        yield from t.to_batches(max_chunksize=10000)

    at = F.col("at").cast("timestamp")
    hour = F.unix_date(F.to_date(at)).cast("long") * 24 + F.hour(at)
    rows = df.select(F.col("entity").cast("string"), F.coalesce(F.unix_micros(at), F.lit(NEVER)).alias("at"), F.coalesce(hour, F.lit(NO_HOUR)).alias("hour"), F.col("percentile").cast("double"))
    return rows.repartition(tasks, "entity", "hour").mapInArrow(mark, MARKED)


def stream_alerts(df: DataFrame, upper: float = 0.85, lower: float = 0.15, cooldown: int = 5) -> DataFrame:
    """Alerts for a stream of (entity, at, percentile).

    State per entity: the zone last seen, the last time, how many days have had values, and which of them
    had the last alert. Rows of a batch are taken in time order; rows not after the last time seen are late
    and ignored. The cooldown counts the entity's own days, as in batch: weekends and holidays do not use it
    up. A crossing within it gives no alert but still moves the zone. Rows without a time come last in their
    batch, as one moment on a day of its own, and leave the state as it is.

    No task holds an entity's batch: the fold lets its rows stream by and keeps marked ones. Only of the hour
    that the batch before ended in it keeps all, as marks do not know which of its rows are late.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        direction, fired, seen, last, day = state.get if state.exists else (None, None, None, None, 0)
        rows, out, resumed, after = [], [], last, (direction, fired, seen, last, day)
        for f in frames:
            if seen is not None:
                f = f[f["at"] > seen]
            f = f[f["turn"] | (f["hour"] == resumed)]
            rows += zip(*(f[c] for c in ("at", "hour", "percentile", "zone", "before")), strict=True)
        for at, hour, p, zone, before in sorted(rows):
            day += last is None or hour // 24 != last // 24
            if before != START and hour != resumed:
                direction = before
            if direction is not None and zone != 0 and zone != direction and (fired is None or day - fired >= cooldown):
                out.append((key[0], at, p, "high" if zone > 0 else "low", "P1" if p >= 0.95 or p <= 0.05 else "P2"))
                fired = day
            if at != NEVER:
                direction, seen, last = zone, at, hour
                after = (direction, fired, seen, last, day)
        state.update(after)
        yield pd.DataFrame(out, columns=["entity", "at", "percentile", "direction", "severity"])

    rows = mark_turns(df, upper, lower, cooldown)
    out = rows.groupBy("entity").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("at", F.when(F.col("at") != NEVER, F.timestamp_micros("at")))


def stream_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and values by type and window, each given once, when the watermark has passed it; its state goes then."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def open_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows that ``stream_counts`` has counted but not given yet, from the state of its last finished batch."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.window.start", "key.event_type", F.col("value.count").alias("n"), F.col("value.sum").alias("total"))
