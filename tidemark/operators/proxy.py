"""Three ratios made up from prices and a rate: coupled recurrences, run over many series at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import ship_package

#: The rate before any is known, the smoothing of the three ratios and its bounds.
FIRST_RATE = 0.035
SMOOTHING = {"pe_ttm": (0.11, 0.05, 0.32), "pe_forward": (0.13, 0.06, 0.34), "pb": (0.08, 0.04, 0.24)}
#: Series that run side by side.
ABREAST = 256


def rate_on(closes: DataFrame, rates: DataFrame, date: str = "d", rate: str = "rate", seed: float = FIRST_RATE) -> DataFrame:
    """Adds ``rate``, the last one at or before each date (before the first: the first; without any: ``seed``), and ``rate_0``, the first.

    Rates are one series for all. They are carried over the calendar of all dates, a few hundred a year, and
    meet the closes by equal dates.
    """
    days = closes.select(date).distinct()
    own = rates.where(F.col(rate).isNotNull()).groupBy(date).agg(F.max(rate).alias("__r"))
    line = days.join(own, date, "full")
    upto = W.orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    first = F.first("__r", True).over(W.orderBy(date).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    line = line.withColumn("rate_0", F.coalesce(first, F.lit(seed))).withColumn(rate, F.coalesce(F.last("__r", True).over(upto), "rate_0")).drop("__r")
    return closes.join(line, date)


def recurrences(close: np.ndarray, rate: np.ndarray, rate_0: np.ndarray, sizes: np.ndarray, anchor: dict[str, np.ndarray], alpha: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ratios of series side by side: ``close`` and ``rate`` are steps by series, the longest series first.

    Averages of three speeds of the price, two of the rate and two of its moves give a signal; each ratio
    follows the day's move, damped, and is drawn to its target. In the end each is scaled so that it ends
    at its anchor.
    """
    a63, a252, a756 = (2 / (n + 1) for n in (63, 252, 756))
    start = np.where(close[0] != 0, close[0], 1.0)
    e63, e252, e756 = start.copy(), start.copy(), start.copy()
    fast, slow = rate_0.copy(), rate_0.copy()
    move_fast, move_slow = np.zeros(len(sizes)), np.zeros(len(sizes))
    level = {m: anchor[m].copy() for m in SMOOTHING}
    raw = {m: np.zeros(close.shape) for m in SMOOTHING}
    bounds = {"pe_ttm": (0.1, 500.0), "pe_forward": (0.1, 500.0), "pb": (0.05, 120.0)}
    before = np.maximum(close[0], 0.01)
    for t in range(len(close)):
        k = int(np.searchsorted(-sizes, -t))  # series that are still going on
        if k == 0:
            break
        c, r = np.maximum(close[t, :k], 0.01), rate[t, :k]
        change = c / before[:k] - 1
        before[:k] = c
        for e, a in ((e63, a63), (e252, a252), (e756, a756)):
            e[:k] += a * (c - e[:k])
        fast[:k] += a63 * (r - fast[:k])
        slow[:k] += a756 * (r - slow[:k])
        move_fast[:k] += a63 * (np.abs(change) - move_fast[:k])
        move_slow[:k] += a252 * (np.abs(change) - move_slow[:k])
        m63, m252, m756 = (np.maximum(e[:k], 0.01) for e in (e63, e252, e756))
        near, mid, far = np.log(c / m63), np.log(c / m252), np.log(m252 / m756)
        gap, momentum, unrest = r - slow[:k], r - fast[:k], move_fast[:k] - move_slow[:k]
        signal = np.clip(near * 1.25 + mid * 0.72 + far * 0.46 - gap * 4.8 - momentum * 1.4 - unrest * 6.2, -0.92, 0.92)
        book = np.clip(signal * 0.62 + far * 0.28 - gap * 1.8 - unrest * 2.2, -0.9, 0.9)
        spread = np.clip(0.085 + far * 0.22 + mid * 0.12 - gap * 0.42 - momentum * 0.2, -0.08, 0.24)
        target = {"pe_ttm": anchor["pe_ttm"][:k] * np.exp(signal)}
        target["pe_forward"] = target["pe_ttm"] * (1 - spread)
        target["pb"] = anchor["pb"][:k] * np.exp(book)
        for m, share, most in (("pe_ttm", 1.2, 0.1), ("pe_forward", 1.05, 0.09), ("pb", 0.9, 0.08)):
            x = np.clip(level[m][:k] * (1 + np.clip(change * share, -most, most)), *bounds[m])
            level[m][:k] = x + alpha[m][:k] * (target[m] - x)
            raw[m][t, :k] = level[m][:k]
    out = {}
    for m, (low, high) in {"pe_ttm": (2.4, 240.0), "pe_forward": (2.0, 120.0), "pb": (0.2, 28.0)}.items():
        end = raw[m][sizes - 1, np.arange(len(sizes))]
        scale = anchor[m] / np.maximum(np.where(end != 0, end, anchor[m]), 0.0001)
        out[m] = np.floor(np.clip(raw[m] * scale, low, high) * 1e4 + 0.5) / 1e4
    out["us10y_yield"] = np.floor(np.clip(rate, 0.001, 0.12) * 1e5 + 0.5) / 1e5
    return out


def proxy_ratios(df: DataFrame, entity: str = "entity", date: str = "d", close: str = "close") -> DataFrame:
    """(entity, date, pe_ttm, pe_forward, pb, us10y_yield) from closes, rates (see ``rate_on``) and anchors.

    ``df`` has anchor_pe_ttm, anchor_pe_forward and anchor_pb on every row, the same for each series, and
    may have alpha_pe_ttm, alpha_pe_forward, alpha_pb. Series are dealt out by entity; a task runs up to
    256 of them abreast, a day of all at a time.
    """
    ship_package(df.sparkSession)
    anchors = [f"anchor_{m}" for m in SMOOTHING]
    alphas = [f"alpha_{m}" for m in SMOOTHING]
    given = {a: F.col(a) if a in df.columns else F.lit(None) for a in alphas}
    rows = df.select(F.col(entity).alias("e"), F.col(date).alias("t"), F.col(close).cast("double").alias("c"), F.col("rate").cast("double"), F.col("rate_0").cast("double"), *[F.col(a).cast("double") for a in anchors], *[c.cast("double").alias(a) for a, c in given.items()])
    schema = f"{entity} {df.schema[entity].dataType.simpleString()}, {date} {df.schema[date].dataType.simpleString()}, pe_ttm double, pe_forward double, pb double, us10y_yield double"

    def solve(series: list[pa.Table]) -> pa.Table:
        series = sorted(series, key=lambda s: -s.num_rows)
        sizes = np.array([s.num_rows for s in series])
        side = lambda name: np.stack([np.pad(s.column(name).to_numpy(), (0, sizes[0] - s.num_rows), constant_values=1.0) for s in series], axis=1)
        one = lambda name: np.array([s.column(name)[0].as_py() for s in series], dtype=float)
        alpha = {}
        for m, (usual, low, high) in SMOOTHING.items():
            x = one(f"alpha_{m}")
            alpha[m] = np.clip(np.where(np.isnan(x), usual, x), low, high)
        made = recurrences(side("c"), side("rate"), one("rate_0"), sizes, {m: one(f"anchor_{m}") for m in SMOOTHING}, alpha)
        tables = [s.select(["e", "t"]).rename_columns([entity, date]) for s in series]
        for j, t in enumerate(tables):
            for name in ("pe_ttm", "pe_forward", "pb", "us10y_yield"):
                t = t.append_column(name, pa.array(made[name][: sizes[j], j]))
            tables[j] = t
        return pa.concat_tables(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, going, now = [], [], None
        for b in batches:
            keys = b.column("e").to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if going and keys[lo] != now:
                    done.append(pa.Table.from_batches(going))
                    going = []
                    if len(done) == ABREAST:
                        yield from solve(done).to_batches()
                        done = []
                now = keys[lo]
                going.append(b.slice(lo, hi - lo))
        if going:
            done.append(pa.Table.from_batches(going))
        if done:
            yield from solve(done).to_batches()

    return rows.where("c IS NOT NULL").repartition("e").sortWithinPartitions("e", "t").mapInArrow(run, schema)
