"""Quarterly rows from several providers: duplicates, merges, rescaling, expected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.dates import quarter_key
from tidemark.functions.numbers import snap_to_anchor
from tidemark.operators.merge import keep_best


def one_per_quarter(rows: DataFrame, entity: str = "entity", date: str = "d", kind: str = "kind") -> DataFrame:
    """One row per entity and quarter: actual before expected, then the earlier date."""
    df = rows.withColumn("quarter", quarter_key(F.col(date)))
    return keep_best(df, [entity, "quarter"], (F.col(kind) != "actual").cast("int"), date)


def merge_rescaled(preferred: DataFrame, other: DataFrame, value: str, anchors: list[float], tolerance: float = 0.22, entity: str = "entity", date: str = "d") -> DataFrame:
    """All quarters of two providers; the other's rows divided by the median ratio where both report.

    The ratio is snapped to a likely factor (a share split, a unit) if it lies near one; entities without
    a common quarter keep their values.
    """
    a = preferred.select(F.col(entity).alias("__e"), quarter_key(F.col(date)).alias("quarter"), F.col(date).alias("__d1"), F.col(value).alias("__v1"))
    b = other.select(F.col(entity).alias("__e"), quarter_key(F.col(date)).alias("quarter"), F.col(date).alias("__d2"), F.col(value).alias("__v2"))
    both = a.join(b, ["__e", "quarter"], "full")
    ratio = F.when(F.abs(F.col("__v1")) > 0, F.col("__v2") / F.col("__v1"))
    factor = both.groupBy("__e").agg(F.median(F.when(ratio > 0, ratio)).alias("__f"))
    factor = factor.select("__e", F.coalesce(snap_to_anchor(F.col("__f"), anchors, tolerance), F.lit(1.0)).alias("factor"))
    out = both.join(factor, "__e")
    return out.select(
        F.col("__e").alias(entity), "quarter", F.coalesce("__d1", "__d2").alias(date), F.coalesce(F.col("__v1").cast("double"), F.col("__v2") / F.col("factor")).alias(value), "factor"
    )


def with_expected(actual: DataFrame, expected: DataFrame, last_close: Column, least_gap: int = 45, horizon: int = 125, entity: str = "entity", date: str = "d") -> DataFrame:
    """Actual rows and at most one expected row each: the first after the last actual, not too near and not too far ahead."""
    last = actual.groupBy(entity).agg(F.max(date).alias("__last"))
    near = expected.join(last, entity).where((F.datediff(date, "__last") >= least_gap) & (F.datediff(F.col(date), last_close) <= horizon))
    first = keep_best(near, [entity], date).select(*expected.columns)
    return actual.withColumn("kind", F.lit("actual")).unionByName(first.withColumn("kind", F.lit("expected")))


def first_by_priority(rows: DataFrame, keys: list[str], metrics: list[str], priority: str) -> DataFrame:
    """Each metric on its own from the provider of lowest priority number that has it, and which that was."""
    pick = lambda m: F.min_by(F.struct(F.col(m).alias("v"), F.col(priority).alias("p")), F.when(F.col(m).isNotNull(), F.col(priority)))
    out = rows.groupBy(*keys).agg(*[pick(m).alias(f"__{m}") for m in metrics])
    tag = F.concat_ws("+", *[F.when(F.col(f"__{m}.v").isNotNull(), F.concat(F.lit(f"{m}:"), F.col(f"__{m}.p").cast("string"))) for m in metrics])
    return out.select(*keys, *[F.col(f"__{m}.v").alias(m) for m in metrics], tag.alias("provenance"))


def basis_mismatch(rows: DataFrame, latest: DataFrame, value: str, entity: str = "entity", date: str = "d", rows_back: int = 8) -> DataFrame:
    """How many times the median of the last rows and a latest value differ, either way round."""
    w = W.partitionBy(entity).orderBy(F.desc(date))
    mid = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= rows_back).groupBy(entity).agg(F.median(value).alias("__m"))
    x = F.col("__m") / F.col("latest")
    return mid.join(latest, entity).where("latest > 0 and __m > 0").select(entity, F.greatest(x, 1 / x).alias("mismatch"))


def keyword_rows(rows: DataFrame, text: str, keywords: dict[str, str], order: str) -> DataFrame:
    """The first row whose text contains each keyword. The dictionary is short and tested row by row, without a join."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(low.contains(k.lower()), F.lit(name)) for name, k in keywords.items()]))
    return keep_best(rows.withColumn("name", F.explode(hits)), ["name"], order)


def basic_stats(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Count, mean, sample deviation (0 for one row), median and extremes."""
    return df.groupBy(entity).agg(
        F.count(value).alias("n"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"),
        F.median(value).alias("median"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def income_from_shares(eps: DataFrame, shares: DataFrame, entity: str = "entity", date: str = "d") -> DataFrame:
    """Expected income as earnings per share times shares: those of the quarter, else the last before, else the latest."""
    from tidemark.operators.asof import asof_join

    s = shares.where(F.col("shares") > 0)
    exact = keep_best(s.withColumn("quarter", quarter_key(F.col(date))), [entity, "quarter"], date).select(entity, "quarter", F.col("shares").alias("__exact"))
    latest = s.groupBy(entity).agg(F.max_by("shares", date).alias("__latest"))
    before = s.select(entity, F.col(date).alias("__day"), F.col("shares").alias("__before"))
    df = asof_join(eps.where(F.col("eps").isNotNull()).withColumn("quarter", quarter_key(F.col(date))), before, entity, date, "__day", ["__before"])
    df = df.join(exact, [entity, "quarter"], "left").join(latest, entity, "left")
    df = df.select(entity, "quarter", date, (F.col("eps") * F.coalesce("__exact", "__before", "__latest")).alias("net_income"))
    return keep_best(df.where("net_income is not null"), [entity, "quarter"], date)


def first_available(rows: DataFrame, key: str, end: str, filed: str) -> DataFrame:
    """The earliest day on which each quarter's figures were out, none before the period's end."""
    return rows.groupBy(key, quarter_key(F.col(end)).alias("quarter")).agg(F.min(F.greatest(end, filed)).alias("available"))


#: Likely factors between earnings per share of two bases.
BASIS_HINTS = [0.1, 0.125, 1 / 6, 0.2, 0.25, 1 / 3, 0.4, 0.5, 2 / 3, 0.8, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0]


def align_to_basis(rows: DataFrame, points: DataFrame, entity: str = "entity", date: str = "d", value: str = "eps", recent: int = 16, least: int = 8) -> DataFrame:
    """Quarterly earnings (kind, available) brought onto the basis of daily points (close, pe_ttm).

    Each actual trailing sum is held against the earnings that the nearest point within a week implies. The factor
    is the median of the last ``recent`` ratios, snapped to a likely one within 12 %. Rows stay as they are with under
    ``least`` ratios or 24 points, a spread of logs above 0.45, a median of 0.7 to 1.43, or a factor outside 0.1 to 10.
    Where the older ratios lie around one and the recent ones far off, only rows from the first recent date on change.
    """
    from tidemark.functions.numbers import round_half_up
    from tidemark.operators.asof import asof_join
    from tidemark.operators.timeseries import trailing_sum

    sums = trailing_sum(rows, entity, date, value, "__sum").where((F.col("kind") == "actual") & (F.abs("__sum") > 1e-8))
    sums = sums.select(entity, F.greatest(F.col(date), F.col("available")).alias("__at"), F.col(date).alias("__quarter"), round_half_up(F.col("__sum"), 6).alias("__sum"))
    # The nearest point counts, usable or not: a sample beside an unusable one is left out.
    implied = F.when((F.col("close") > 0) & (F.abs("pe_ttm") > 1e-8), F.col("close") / F.col("pe_ttm"))
    near = asof_join(sums, points.select(entity, F.col(date).alias("__day"), implied.alias("__implied")), entity, "__at", "__day", ["__implied"], direction="nearest", tolerance_days=7)
    ratios = near.withColumn("__ratio", F.col("__implied") / F.when(F.col("__sum") != 0, F.col("__sum"))).where(F.col("__ratio") > 0)
    back = W.partitionBy(entity).orderBy(F.desc("__at"), F.desc("__quarter"))
    ratios = ratios.withColumn("__recent", F.row_number().over(back) <= recent)
    now, old = F.when(F.col("__recent"), F.col("__ratio")), F.when(~F.col("__recent"), F.col("__ratio"))
    found = ratios.groupBy(entity).agg(
        F.count(F.lit(1)).alias("__n"), F.median(now).alias("__m"), F.median(old).alias("__old"), F.count(old).alias("__n_old"), F.min(F.when(F.col("__recent"), F.col("__at"))).alias("__from")
    )
    spread = ratios.where("__recent").join(found, entity).groupBy(entity).agg(F.median(F.abs(F.log("__ratio") - F.log("__m"))).alias("__spread"))
    enough = points.groupBy(entity).agg(F.count(F.lit(1)).alias("__points")).where(F.col("__points") >= 24)
    factor = snap_to_anchor(F.col("__m"), BASIS_HINTS, 0.12)
    found = found.join(spread, entity).join(enough, entity).withColumn("__factor", factor)
    found = found.where((F.col("__n") >= least) & (F.col("__spread") <= 0.45) & ~F.col("__m").between(0.7, 1.43) & F.col("__factor").between(0.1, 10))
    shift = F.col("__m") / F.col("__old")
    changed = (F.col("__n_old") >= least) & F.col("__old").between(0.8, 1.25) & ((shift >= 1.8) | (shift <= 0.55))
    found = found.select(entity, "__factor", F.when(changed, F.col("__from")).alias("__cut"))
    use = F.col("__factor").isNotNull() & (F.col("__cut").isNull() | (F.col(date) >= F.col("__cut")))
    out = rows.join(found, entity, "left").withColumn(value, F.when(use, round_half_up(F.col(value) * F.col("__factor"), 6)).otherwise(F.col(value)))
    return out.select(*rows.columns)


def merge_expected(forecast: DataFrame, estimated: DataFrame, entity: str = "entity", date: str = "d", value: str = "net_income") -> DataFrame:
    """Expected figures of each quarter: a direct forecast before an estimate from earnings and shares, then the earlier date."""
    from tidemark.functions.numbers import finite, round_half_up

    rows = forecast.select(entity, date, value, F.lit(0).alias("__rank")).unionByName(estimated.select(entity, date, value, F.lit(1).alias("__rank")))
    rows = rows.withColumns({"quarter": quarter_key(F.col(date)), value: round_half_up(finite(F.col(value)), 3)}).where(F.col(value).isNotNull() & F.col(date).isNotNull())
    return keep_best(rows, [entity, "quarter"], "__rank", date).select(entity, "quarter", date, value, (F.col("__rank") == 0).alias("direct"))
