"""Framed percentile ranks, z-scores and moving averages over a series' own history."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TRADING_DAYS = 252
#: Rows of a series that are sorted together.
BLOCK = 512


def row_frame(entity: str, order: str, rows: int | None) -> WindowSpec:
    """The last ``rows`` rows up to the current one; all of them if None."""
    w = W.partitionBy(entity).orderBy(order)
    return w.rowsBetween(W.unboundedPreceding if rows is None else -(rows - 1), 0)


def share_at_most(values: Column, current: Column) -> Column:
    """The share of an array that is at most ``current``; 0.5 of an empty one."""
    return F.when(F.size(values) == 0, 0.5).otherwise(F.size(F.filter(values, lambda x: x <= current)) / F.size(values))


def percentile_rank(key: str, frame: WindowSpec) -> Column:
    """Share of the frame's values that are at most the current row's, ties included, so a first row has 1."""
    return share_at_most(F.collect_list(key).over(frame), F.col(key))


def z_score(value: str, frame: WindowSpec, least: float = 0.0) -> Column:
    """Distance from the frame's mean in sample deviations; 0 for a single row or a deviation up to ``least``."""
    sd = F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0))
    return F.when(sd > least, (F.col(value) - F.avg(value).over(frame)) / sd).otherwise(0.0)


def at_most_before(x: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For every place i how many values at places up to ``upto[i]`` are at most x[i]; NaN is never counted.

    The series is cut into blocks, each sorted once: whole blocks are answered by binary search, the
    one block that a limit falls into by comparison. Memory is bounded by the block.
    """
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        block = x[at : at + BLOCK]
        ordered = np.sort(block[~np.isnan(block)])
        whole = upto >= at + len(block) - 1
        out[whole] += np.searchsorted(ordered, x[whole], "right")
        for cut in np.array_split(np.flatnonzero((upto >= at) & ~whole), 1 + len(x) // (8 * BLOCK)):
            out[cut] += ((block[None, :] <= x[cut, None]) & (np.arange(at, at + len(block))[None, :] <= upto[cut, None])).sum(axis=1)
    out[np.isnan(x)] = 0
    return out


def last_rows(n: int, rows: int | None) -> np.ndarray | None:
    """For each place the one before the last ``rows`` rows up to it; None for all rows."""
    return None if rows is None or rows >= n else np.arange(n) - rows


def last_years(days: np.ndarray, years: int) -> np.ndarray:
    """For each of the sorted days the place before the first day within its last calendar years; 29 February looks back to the 28th."""
    month = days.astype("datetime64[M]")
    then = month - 12 * years
    longest = (then + 1).astype("datetime64[D]") - then.astype("datetime64[D]") - np.timedelta64(1, "D")
    return np.searchsorted(days, then.astype("datetime64[D]") + np.minimum(days - month.astype("datetime64[D]"), longest), "left") - 1


def framed_rank(x: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Each value's share of values at most it among the rows after the place ``before`` (all if None) up to its own; 0.5 of none."""
    here = np.arange(len(x))
    seen = np.cumsum(~np.isnan(x))
    hits, size = at_most_before(x, here), seen.copy()
    if before is not None:
        hits = hits - at_most_before(x, before)
        size = size - np.where(before >= 0, seen[np.maximum(before, 0)], 0)
    return np.where(size > 0, hits / np.maximum(size, 1), 0.5)


def framed_ranks(df: DataFrame, entity: str, order: str, key: str, frames: dict[str, int | None], years: dict[str, int] | None = None) -> DataFrame:
    """Adds a percentile rank of ``key`` for each frame of so many last rows, or of all rows so far, or of so many calendar ``years``.

    Like ``percentile_rank``, in a time that grows with the series and not with its square, and without an
    array in every row. One task holds one entity's series, which is bounded by its dates.
    """
    from pyspark.sql.types import DoubleType, StructType

    from tidemark.session import ship_package

    ship_package(df.sparkSession)
    schema = StructType([*df.schema.fields])
    for out in [*frames, *(years or {})]:
        schema = schema.add(out, DoubleType())

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x = table.column(key).to_numpy().astype(np.float64)
        for out, rows in frames.items():
            table = table.append_column(out, pa.array(framed_rank(x, last_rows(len(x), rows))))
        for out, n in (years or {}).items():
            table = table.append_column(out, pa.array(framed_rank(x, last_years(table.column(order).to_numpy().astype("datetime64[D]"), n))))
        return table

    return df.groupBy(entity).applyInArrow(run, schema)


def expanding_percentile(df: DataFrame, entity: str, order: str, value: str, out: str = "percentile") -> DataFrame:
    """The percentile among all rows so far."""
    return framed_ranks(df, entity, order, value, {out: None})


def ema(df: DataFrame, entity: str, order: str, value: str, span: int, out: str) -> DataFrame:
    """Exponential moving average with weight 2 / (span + 1), started at the first value."""
    from pyspark.sql.types import DoubleType, StructType

    from tidemark.session import ship_package

    ship_package(df.sparkSession)
    a = 2.0 / (span + 1)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x = table.column(value).to_numpy().astype(np.float64)
        level = np.empty(len(x))
        for i, v in enumerate(x):
            level[i] = v if i == 0 else level[i - 1] + a * (v - level[i - 1])
        return table.append_column(out, pa.array(level))

    rows = df.select(entity, order, value)
    return rows.groupBy(entity).applyInArrow(run, StructType([*rows.schema.fields]).add(out, DoubleType()))


def previous(value: str, entity: str, order: str, steps: int = 1) -> Column:
    return F.lag(value, steps).over(W.partitionBy(entity).orderBy(order))


def daily_return(value: str, entity: str, order: str, widest: int = 4) -> Column:
    """Change on the day before; null over a gap of more than ``widest`` days."""
    w = W.partitionBy(entity).orderBy(order)
    near = F.datediff(F.col(order), F.lag(order).over(w)) <= widest
    return F.when(near, F.col(value) / F.lag(value).over(w) - 1)
