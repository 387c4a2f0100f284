"""Which of a provider's daily snapshots say something new: one state per series and metric, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.text import has_source_tag
from tidemark.operators.asof import asof_join
from tidemark.session import ship_package

#: Metrics of a snapshot, how far a value may be from what was carried, sources that state a latest value.
METRICS = ("pe_ttm", "pe_forward", "pb", "peg")
TOLERANCE = 0.01
EXPLICIT = ("yahoo-key-statistics-valuation-measures", "yahoo-quote-summary-latest", "yahoo-quote-api-latest")
#: The sources that are trusted for each metric.
TRUSTED = {
    "pe_ttm": ("yahoo-trailing-pe-timeseries", *EXPLICIT),
    "pe_forward": ("yahoo-forward-pe-timeseries", *EXPLICIT),
    "pb": EXPLICIT,
    "peg": ("yahoo-trailing-peg-timeseries", *EXPLICIT),
}
#: Smaller values count as none.
LEAST = 1e-8


@dataclass
class LastAccepted:
    """The state of one series and metric: its last accepted value and the close of that day.

    A value that only repeats the last one moved with the price says nothing new. From a source that
    states latest values it is the other way round: there an unchanged value while the price has moved is
    stale. Without positive closes on both days nothing can be told, and the value is not taken.
    """

    value: float | None = None
    close: float | None = None

    def takes(self, value: float, close: float | None, explicit: bool, tolerance: float = TOLERANCE) -> bool:
        """Whether a value is accepted; if so it becomes the last one."""
        new = self.value is None or self._differs(value, close, explicit, 1 + tolerance)
        if new:
            self.value, self.close = value, close
        return new

    def _differs(self, value: float, close: float | None, explicit: bool, most: float) -> bool:
        if not (self.close and close and self.close > 0 and close > 0):
            return False
        move = close / self.close
        if explicit:
            return self._fold(value, self.value) > most or max(move, 1 / move) <= most
        return self._fold(value, self.value * move) > most

    def _fold(self, value: float, other: float) -> float:
        if self.value * value <= 0 or abs(other) < LEAST or abs(value) < LEAST:
            return float("inf")
        return max(abs(value / other), abs(other / value))


def long_snapshots(snapshots: DataFrame, entity: str, date: str, source: str) -> DataFrame:
    """(entity, date, explicit, metric, value): a row for each usable value of a source that is trusted for its metric."""
    tag = F.coalesce(F.col(source), F.lit(""))
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(has_source_tag(tag, list(TRUSTED[m])), F.col(m).cast("double")).alias("value")) for m in METRICS])
    rows = snapshots.where(F.col(date).isNotNull()).select(entity, date, has_source_tag(tag, list(EXPLICIT)).alias("explicit"), F.inline(values))
    return rows.where((F.abs("value") >= LEAST) & (F.abs("value") < float("inf")))


def with_close(rows: DataFrame, closes: DataFrame, entity: str, date: str, close: str) -> DataFrame:
    """The close at or before each row's date, or the series' first."""
    prices = closes.select(entity, F.col(date).alias("__day"), F.col(close).cast("double").alias("close"))
    return asof_join(rows, prices, entity, date, "__day", ["close"], before_first="first").drop("asof_date")


def effective_snapshots(snapshots: DataFrame, closes: DataFrame, entity: str = "entity", date: str = "d", close: str = "close", source: str = "source", tolerance: float = TOLERANCE) -> DataFrame:
    """The snapshots with only those values that say something new; snapshots without any are left out.

    Metrics do not depend on each other, so the fold runs per series and metric. Entities without closes
    give nothing. Several snapshots of one day are taken in the order of their sources.
    """
    ship_package(snapshots.sparkSession)
    rows = with_close(long_snapshots(snapshots, entity, date, source), closes, entity, date, close)
    schema = rows.schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(date, "ascending"), ("explicit", "ascending"), ("value", "ascending")])
        state = LastAccepted()
        keep = [state.takes(v, c, e, tolerance) for v, c, e in zip(*(table.column(x).to_pylist() for x in ("value", "close", "explicit")))]
        return table.filter(pa.array(keep, pa.bool_()))

    taken = rows.where("close IS NOT NULL").groupBy(entity, "metric").applyInArrow(run, schema)
    return wide_snapshots(taken, entity, date)


def wide_snapshots(taken: DataFrame, entity: str = "entity", date: str = "d") -> DataFrame:
    return taken.groupBy(entity, date).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in METRICS])


class _Accept(StatefulProcessor):
    """The same fold over a stream: late values (not after the last date seen) are ignored."""

    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "value double, close double, seen date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value, close, seen = self.state.get() if self.state.exists() else (None, None, None)
        last, out = LastAccepted(value, close), []
        for d, explicit, v, c in sorted((d, bool(e), float(v), float(c)) for f in rows for d, e, v, c in zip(f["d"], f["explicit"], f["value"], f["close"], strict=True)):
            if seen is not None and d <= seen:
                continue
            seen = d
            if last.takes(v, c, explicit, self.tolerance):
                out.append((key[0], d, key[1], v))
        self.state.update((last.value, last.close, seen))
        yield pd.DataFrame(out, columns=["entity", "d", "metric", "value"])

    def close(self) -> None:
        pass


def stream_snapshots(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Accepted values of a stream of (entity, d, metric, value, close, explicit), as (entity, d, metric, value).

    State per (entity, metric) is one value, its close and the last date. Needs the RocksDB state store.
    """
    return rows.groupBy("entity", "metric").transformWithStateInPandas(_Accept(tolerance), "entity string, d date, metric string, value double", "Append", "None")
