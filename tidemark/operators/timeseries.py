"""Reconstruction of daily series from sparse anchors and other series."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.dates import weekdays_between


def _bracket(entity: str, date: str, value: str) -> dict[str, Column]:
    """Date and value of the last known row at or before, and of the first at or after, as columns."""
    back = W.partitionBy(entity).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    # Seen from the end the frame grows; a shrinking one is quadratic in Spark.
    ahead = W.partitionBy(entity).orderBy(F.desc(date)).rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.col(date))
    return {
        "__d0": F.last(known, True).over(back),
        "__v0": F.last(value, True).over(back),
        "__d1": F.last(known, True).over(ahead),
        "__v1": F.last(value, True).over(ahead),
    }


def interpolate(df: DataFrame, entity: str, date: str, value: str, out: str, widest: int | None = None, before_first: str = "flat", fill: int | None = None) -> DataFrame:
    """Linear between known values by days; null inside gaps over ``widest`` days.

    Before the first it is flat or, with ``before_first`` = "null", null; after the last it is flat, for ``fill`` days if given.
    """
    df = df.withColumns(_bracket(entity, date, value))
    span = F.datediff("__d1", "__d0")
    between = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.datediff(date, "__d0") / span
    inside = between if widest is None else F.when(span <= widest, between)
    ahead = F.col("__v1") if before_first == "flat" else F.lit(None).cast("double")
    after = F.col("__v0") if fill is None else F.when(F.datediff(date, "__d0") <= fill, F.col("__v0"))
    v = F.when(F.col("__d0").isNull(), ahead).when(F.col("__d1").isNull(), after).when(span == 0, F.col("__v0")).otherwise(inside)
    return df.withColumn(out, v).drop("__d0", "__v0", "__d1", "__v1")


def carry_last(df: DataFrame, entity: str, date: str, value: str, out: str) -> DataFrame:
    w = W.partitionBy(entity).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, True).over(w))


def price_carry(df: DataFrame, entity: str, date: str, value: str, price: str, out: str) -> DataFrame:
    """The last known value moved with the price since; before the first, moved back from it."""
    back = W.partitionBy(entity).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(entity).orderBy(F.desc(date)).rowsBetween(W.unboundedPreceding, 0)
    ratio = F.when(F.col(price) > 0, F.col(value) / F.col(price))
    return df.withColumn(out, F.coalesce(value, F.coalesce(F.last(ratio, True).over(back), F.last(ratio, True).over(ahead)) * F.col(price)))


def log_bridge(df: DataFrame, entity: str, date: str, value: str, price: str, out: str) -> DataFrame:
    """Values that follow the price between anchors and meet both: the log of value / price is interpolated by days."""
    ratio = df.withColumn("__log", F.when((F.col(value) > 0) & (F.col(price) > 0), F.log(F.col(value) / F.col(price))))
    return interpolate(ratio, entity, date, "__log", "__l").withColumn(out, F.exp("__l") * F.col(price)).drop("__log", "__l")


#: The bound of every ratio, the least size of a usable number; folds and least value of a change of basis.
MOST_RATIO, TINY = 1_000_000.0, 1e-8
BASIS_FOLD, BASIS_LEAST = (1.15, 4.0), 4.0


def rebase_history(df: DataFrame, cuts: DataFrame, entity: str, date: str, value: str, close: str) -> DataFrame:
    """History brought onto the basis that a series has from its cut-over on (``cuts``: entity, cut).

    The cut-over row is the first on or after the day with a value of at least 4 and a positive close; the row
    before is the last such one ahead of it. Their values, less the move of the close between them, give
    the factor. If it departs from 1 by 1.15 to 4 fold, every earlier value is multiplied, small and negative
    ones too, and rounded to 4 digits. A series without either row stays as it is.
    """
    from tidemark.functions.numbers import clamp, round_half_up

    good = df.where((F.col(value) >= BASIS_LEAST) & (F.col(value) < float("inf")) & (F.col(close) > 0)).join(cuts, entity)
    row = F.struct(F.col(date).alias("d"), F.col(value).alias("v"), F.col(close).alias("c"))
    at = good.groupBy(entity).agg(F.min(F.when(F.col(date) >= F.col("cut"), row)).alias("__at"))
    before = good.join(at, entity).where(F.col(date) < F.col("__at.d")).groupBy(entity).agg(F.max(row).alias("__old"), F.first("__at").alias("__at"))
    factor = F.col("__at.v") / (F.col("__old.v") * (F.col("__at.c") / F.col("__old.c")))
    found = before.select(entity, F.col("__at.d").alias("__cut"), factor.alias("__factor")).where(F.greatest("__factor", 1 / F.col("__factor")).between(*BASIS_FOLD))
    moved = F.col(value) * F.col("__factor")
    use = (F.col(date) < F.col("__cut")) & (F.abs(value) >= TINY) & (F.abs(moved) >= TINY) & (F.abs(moved - F.col(value)) > 1e-6)
    out = F.when(use, round_half_up(clamp(moved, -MOST_RATIO, MOST_RATIO), 4)).otherwise(F.col(value))
    return df.join(found, entity, "left").withColumn(value, out).drop("__cut", "__factor")


def forward_start(closes: DataFrame, forward: DataFrame, history: DataFrame, entity: str, date: str, least: int = 4, coverage: int = 126) -> DataFrame:
    """From when on each series has forward values: its first forward anchor if there are enough, else a stored
    start that leaves at least ``coverage`` closes, else its first close; never before the first close."""
    back = W.partitionBy(entity).orderBy(F.desc(date))
    n = closes.withColumn("__n", F.row_number().over(back))
    c = n.groupBy(entity).agg(F.min(date).alias("__c0"), F.min(F.when(F.col("__n") <= coverage, F.col(date))).alias("__covers"))
    f = forward.groupBy(entity).agg(F.min(date).alias("__f0"), F.count(F.lit(1)).alias("__f"))
    df = c.join(f, entity, "left").join(history, entity, "left")
    start = F.when(F.col("__f") >= least, F.greatest("__f0", "__c0")).when(F.col("history_start") <= F.col("__covers"), F.greatest("history_start", "__c0"))
    return df.select(entity, F.coalesce(start, F.col("__c0")).alias("forward_start"))


def growth_on_year(df: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    """Change on the last value a year before; null without one or where nothing changed."""
    from tidemark.functions.dates import subtract_years
    from tidemark.operators.asof import asof_join

    then = df.select(entity, F.col(date).alias("__then"), F.col(value).alias("__old"))
    out = asof_join(df.withColumn("__t", subtract_years(F.col(date), 1)), then, entity, "__t", "__then", ["__old"])
    growth = F.col(value) / F.when(F.abs(F.col("__old")) > 1e-8, F.col("__old")) - 1
    return out.withColumn("growth", F.when(F.abs(growth) > 1e-8, growth))


def forward_from_trailing(df: DataFrame, last: DataFrame, entity: str, date: str, value: str, years: int = 8, most: float = MOST_RATIO) -> DataFrame:
    """A forward series as the trailing one times their latest ratio, for the last years; none where the ratio is out of bounds."""
    from tidemark.functions.dates import subtract_years
    from tidemark.functions.numbers import clamp, round_half_up

    ends = df.groupBy(entity).agg(F.max(date).alias("__end")).join(last, entity)
    ratio = F.col("latest_forward") / F.when(F.abs(F.col("latest")) > 1e-8, F.col("latest"))
    ends = ends.withColumn("__ratio", ratio).where(F.abs(F.col("__ratio")).between(0.35, 3.5))
    out = df.join(ends.select(entity, "__end", "__ratio"), entity).where(F.col(date) >= subtract_years(F.col("__end"), years))
    return out.select(entity, date, round_half_up(clamp(F.col(value) * F.col("__ratio"), -most, most), 4).alias("value"))


def override_with_actual(df: DataFrame, actual: DataFrame, entity: str, date: str, value: str, close: str, stale: int = 190, fold: float = 3.5, most: float = MOST_RATIO) -> DataFrame:
    """Recent ratios as close over the latest actual earnings (start, eps of each series, and cutoff if snapshots begin).

    Left alone where the earnings are older than ``stale`` days, their ratio departs ``fold`` times from the
    series' last, as for listings in another currency, or snapshots begin at or before the start; where they
    begin later, rows from then on keep their values.
    """
    from tidemark.functions.numbers import round_half_up

    cutoff = F.col("cutoff") if "cutoff" in actual.columns else F.lit(None).cast("date")
    last = df.groupBy(entity).agg(F.max(date).alias("__end"), F.max_by(close, date).alias("__close"), F.max_by(value, date).alias("__last"))
    use = last.join(actual.select(entity, "start", "eps", cutoff.alias("__cutoff")), entity).where(F.abs(F.col("eps")) > TINY)
    based = F.when(F.col("__close") > 0, F.col("__close") / F.col("eps"))
    shown = F.when(F.abs("__last") >= TINY, F.col("__last"))
    near = F.greatest(shown / based, based / shown) < fold
    free = F.coalesce(F.col("__cutoff") > F.col("start"), F.lit(True))
    use = use.where(F.datediff("__end", "start").between(0, stale) & free & F.coalesce(near, F.lit(True))).select(entity, "start", "eps", "__cutoff")
    ratio = F.col(close) / F.col("eps")
    inside = (F.col(date) >= F.col("start")) & F.coalesce(F.col(date) < F.col("__cutoff"), F.lit(True))
    fits = F.coalesce(inside & (F.col(close) > 0) & (F.abs(ratio) <= most), F.lit(False))
    return df.join(use, entity, "left").withColumn(value, F.when(fits, round_half_up(ratio, 6)).otherwise(F.col(value))).drop("start", "eps", "__cutoff")


def anchor_denominators(closes: DataFrame, anchors: DataFrame, entity: str, date: str, close: str, fallback: float) -> DataFrame:
    """Close over ratio at each anchor with a usable ratio; a series without any gets one at its first close."""
    from tidemark.operators.asof import asof_join

    prices = closes.select(entity, F.col(date).alias("__day"), F.col(close).alias("__close"))
    good = anchors.where(F.abs(F.col("ratio")) > 1e-8).select(entity, F.col(date).alias("__a"), "ratio")
    found = asof_join(good, prices, entity, "__a", "__day", ["__close"], before_first="first")
    found = found.select(entity, F.col("__a").alias(date), "ratio", (F.col("__close") / F.col("ratio")).alias("denominator"), F.lit(False).alias("fallback"))
    first = closes.groupBy(entity).agg(F.min(date).alias(date), F.min_by(close, date).alias("__c")).join(good.select(entity).distinct(), entity, "left_anti")
    return found.unionByName(first.select(entity, date, F.lit(fallback).alias("ratio"), (F.col("__c") / fallback).alias("denominator"), F.lit(True).alias("fallback")))


def book_anchor(pb: Column, pe: Column, base_pe: Column) -> Column:
    """A price-to-book ratio that moves with the earnings ratio, damped."""
    from tidemark.functions.numbers import clamp

    return clamp(pb * F.pow(pe / base_pe, F.lit(0.72)), 0.5, 16)


def positive_points(df: DataFrame, value: str) -> DataFrame:
    """A metric's rows that can stand as closes: finite and above zero."""
    return df.where((F.col(value) > 0) & (F.col(value) < float("inf")))


def trailing_sum(df: DataFrame, entity: str, date: str, value: str, out: str, shortest: int = 40, longest: int = 140) -> DataFrame:
    """The sum of the last four quarters, only where all three gaps between them are plausible."""
    w = W.partitionBy(entity).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    df = df.withColumn("__ok", gap.between(shortest, longest).cast("int"))
    four = w.rowsBetween(-3, 0)
    good = (F.count(value).over(four) == 4) & (F.sum("__ok").over(w.rowsBetween(-2, 0)) == 3)
    return df.withColumn(out, F.when(good, F.sum(value).over(four))).drop("__ok")


def yearly_growth(df: DataFrame, entity: str, date: str, value: str, out: str, most: float = 20.0) -> DataFrame:
    """Change on four rows before, null from a base that is not positive or beyond ``most``-fold."""
    before = F.lag(value, 4).over(W.partitionBy(entity).orderBy(date))
    growth = F.col(value) / before - 1
    return df.withColumn(out, F.when((before > 0) & (F.abs(growth) <= most), growth))


def median_gap(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Rows, median days between them, and whether the series is coarse (120 days or fewer than three rows)."""
    gap = F.datediff(F.col(date), F.lag(date).over(W.partitionBy(entity).orderBy(date)))
    rows = df.withColumn("__g", gap).groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), F.median("__g").cast("double").alias("median_gap"))
    return rows.withColumn("coarse", (F.col("n_rows") < 3) | (F.col("median_gap") >= 120))


def median_and_spread(df: DataFrame, entity: str, ratio: str) -> DataFrame:
    """Median of a ratio and the median absolute deviation of its logs."""
    mid = df.where(F.col(ratio) > 0).groupBy(entity).agg(F.median(ratio).alias("median_ratio"))
    dev = df.where(F.col(ratio) > 0).join(mid, entity).withColumn("__dev", F.abs(F.log(ratio) - F.log("median_ratio")))
    return dev.groupBy(entity).agg(F.first("median_ratio").alias("median_ratio"), F.median("__dev").alias("log_mad"))


def fill_weekdays(df: DataFrame, entity: str, date: str, value: str, longest: int = 4) -> DataFrame:
    """Adds the weekdays of gaps over ``longest`` days, on a geometric path between both ends."""
    w = W.partitionBy(entity).orderBy(date)
    rows = df.select(entity, date, value).withColumns({"__next": F.lead(date).over(w), "__end": F.lead(value).over(w)})
    gaps = rows.where(F.datediff("__next", date) > longest).withColumn("__days", weekdays_between(F.col(date), F.col("__next")))
    steps = gaps.select(entity, F.col(value).alias("__v"), "__end", F.size("__days").alias("__n"), F.posexplode("__days").alias("__i", "__day"))
    path = F.col("__v") * F.pow(F.col("__end") / F.col("__v"), (F.col("__i") + 1) / (F.col("__n") + 1))
    made = steps.select(entity, F.col("__day").alias(date), path.alias(value), F.lit(True).alias("filled"))
    return df.select(entity, date, value, F.lit(False).alias("filled")).unionByName(made)


def fill_like_recent(df: DataFrame, entity: str, date: str, value: str, longest: int = 4, recent: int = 252) -> DataFrame:
    """Adds the weekdays of gaps over ``longest`` days, moving like the entity's last daily returns and meeting both ends.

    Returns over at most ``longest`` days between positive values, above -0.95 and below 2.5, are the template (the
    last ``recent`` of all dates). The k-th gap with weekdays starts at place 17 * k of it, going round; returns
    are clamped to 0.35, and a drift of logs leads to the end. Where the drift is 1.6 or more or undefined, the
    path is geometric. An entity without such returns is not filled.
    """
    w = W.partitionBy(entity).orderBy(date)
    rows = df.select(entity, date, F.col(value).cast("double").alias(value))
    rows = rows.withColumns({"__next": F.lead(date).over(w), "__end": F.lead(value).over(w)}).withColumn("__gap", F.datediff("__next", date))
    ok = (F.col("__gap") <= longest) & (F.col(value) > 0) & (F.col("__end") > 0)
    daily = rows.where(ok).withColumn("__r", F.col("__end") / F.col(value) - 1).where("__r > -0.95 and __r < 2.5")
    daily = daily.withColumn("__back", F.row_number().over(W.partitionBy(entity).orderBy(F.desc(date)))).where(F.col("__back") <= recent)
    own = W.partitionBy(entity)
    template = daily.select(
        F.col(entity).alias("__e"),
        F.count(F.lit(1)).over(own).alias("__size"),
        (F.count(F.lit(1)).over(own) - F.col("__back")).alias("__place"),
        F.log1p(F.greatest(F.lit(-0.35), F.least(F.lit(0.35), "__r"))).alias("__log"),
    )
    gaps = rows.where(F.col("__gap") > longest).withColumn("__days", weekdays_between(F.col(date), F.col("__next"))).where(F.size("__days") > 0)
    gaps = gaps.withColumn("__k", F.row_number().over(w) - 1)
    sizes = template.select("__e", "__size").distinct()
    gaps = gaps.join(sizes, F.col(entity) == F.col("__e")).drop("__e")
    # One row per step; the last one leads to the right end and adds no day.
    steps = gaps.select(entity, "__k", "__size", F.col(value).alias("__v"), "__end", F.size("__days").alias("__n"), F.posexplode(F.concat("__days", F.array("__next"))).alias("__i", "__day"))
    steps = steps.withColumn("__at", (F.col("__k") * 17 + F.col("__i")) % F.col("__size"))
    steps = steps.join(template.drop("__size"), (F.col(entity) == F.col("__e")) & (F.col("__at") == F.col("__place")))
    gap = W.partitionBy(entity, "__k")
    # A quotient that is no number gives no drift and an undefined path; log needs a positive one.
    ratio = F.when(F.col("__v") != 0, F.col("__end") / F.col("__v"))
    target = F.log(F.greatest(ratio, F.lit(1e-9)))
    steps = steps.withColumn("__drift", (target - F.sum("__log").over(gap)) / (F.col("__n") + 1))
    step = F.when(F.abs("__drift") < 1.6, F.greatest(F.lit(-1.5), F.least(F.lit(1.5), F.col("__log") + F.col("__drift")))).otherwise(target / (F.col("__n") + 1))
    upto = gap.orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    path = F.greatest(F.col("__v") * F.exp(F.sum(step).over(upto)), F.lit(1e-8))
    made = steps.withColumn("__path", path).where(F.col("__i") < F.col("__n"))
    made = made.select(entity, F.col("__day").alias(date), F.col("__path").alias(value), F.lit(True).alias("filled"))
    return df.select(entity, date, value, F.lit(False).alias("filled")).unionByName(made)


def drop_spikes(
    df: DataFrame,
    entity: str,
    date: str,
    value: str,
    fold: float = 1.9,
    calm: float = 1.35,
    widest: int = 40,
    pulse: float = 1.34,
    pulse_days: int = 5,
    least: float = 4.0,
    passes: int = 4,
) -> DataFrame:
    """Nulls values that jump away from both neighbours while these agree; later rows see earlier nulls.

    Neighbours are the nearest values that are left, of the same sign, at most ``widest`` days away and at most
    ``calm`` fold apart; all three must be ``least`` in size. A jump is ``fold`` from both, or ``pulse`` from both
    above or below them within ``pulse_days``. The rule is sequential, so each entity is one group.
    """

    def spike(before: tuple, now: tuple, after: tuple) -> bool:
        (d0, a), (d1, b), (d2, c) = before, now, after
        gap = max(d1 - d0, d2 - d1)
        if gap > widest or min(d1 - d0, d2 - d1) <= 0 or min(abs(a), abs(b), abs(c)) < least or a * c <= 0:
            return False
        apart = lambda x, y: max(abs(x / y), abs(y / x))
        if apart(a, c) > calm:
            return False
        jump = min(apart(b, a), apart(b, c))
        return jump >= fold or jump >= pulse and gap <= pulse_days and (b > max(a, c) or b < min(a, c))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(date, kind="stable").reset_index(drop=True)
        day = pd.to_datetime(f[date]).map(lambda x: x.toordinal())
        found = [(i, float(x)) for i, x in enumerate(f[value]) if not pd.isna(x)]
        left = [(i, (day[i], x)) for i, x in found if math.isfinite(x) and abs(x) >= 1e-8]
        for _ in range(passes):
            kept = left[:1]
            for now, after in zip(left[1:], left[2:], strict=False):
                if not spike(kept[-1][1], now[1], after[1]):
                    kept.append(now)
            kept += left[1:][-1:]
            if len(kept) == len(left):
                break
            left = kept
        values = [None] * len(f)
        for i, (_, x) in left:
            values[i] = x
        return f.assign(**{value: pd.array(values, dtype="Float64")})

    return df.groupBy(entity).applyInPandas(run, df.schema)


def accept_snapshots(df: DataFrame, entity: str, date: str, value: str, price: str, tolerance: float = 0.01) -> DataFrame:
    """Drops snapshots that only repeat the last accepted one moved with the price."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        keep, last = [], None
        f = f.sort_values(date, kind="stable")
        for v, p in zip(f[value], f[price], strict=True):
            good = v == v and p == p and v is not None and p is not None and p > 0
            carried = good and last is not None and abs(v / (last[0] * p / last[1]) - 1) <= tolerance
            keep.append(bool(good and not carried))
            if keep[-1]:
                last = (v, p)
        return f[keep]

    return df.groupBy(entity).applyInPandas(run, df.schema)


def proxy_series(df: DataFrame, entity: str, date: str, price: str, rate: str, anchor: float, out: str, span: int = 252, low: float = 0.35, high: float = 3.0) -> DataFrame:
    """A ratio made up from prices and rates: premium over a moving average, smoothed, and scaled to end at ``anchor``."""
    a = 2.0 / (span + 1)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(date, kind="stable")
        mean = base = None
        level, values = 1.0, []
        for p, r in zip(f[price], f[rate], strict=True):
            mean = p if mean is None else mean + a * (p - mean)
            base = r if base is None else base + a * (r - base)
            signal = min(high, max(low, math.exp(math.log(p / mean) - 4 * (r - base)))) if p > 0 and mean > 0 else 1.0
            level += 0.1 * (signal - level)
            values.append(level)
        return f.assign(**{out: [x * anchor / values[-1] for x in values]})

    from pyspark.sql.types import DoubleType, StructType

    return df.groupBy(entity).applyInPandas(run, StructType([*df.schema.fields]).add(out, DoubleType()))
