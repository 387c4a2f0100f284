"""Ratio payloads of several providers: merged with a precedence that the data decide, or read in stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.timeseries import drop_spikes
from tidemark.operators.valuation import usable
from tidemark.session import cut_lineage

METRICS = ("pe_ttm", "pe_forward", "pb", "peg")
#: Days that a long series stays fresh, how far a latest value may be off it, how far from its own anchors.
FRESH_DAYS, OUTLIER, MISMATCH = 120, 3.2, 3.5
#: Rows of a long series from which anchors of another basis are dropped; anchors that tell the basis; a coarse gap.
ENOUGH, RECENT, COARSE_DAYS = 16, 8, 120
#: Spikes of the two earnings ratios (see ``drop_spikes``).
SPIKES = {
    "pe_ttm": {"fold": 1.9, "pulse": 1.3, "calm": 1.28, "widest": 16, "pulse_days": 8, "least": 4.0},
    "pe_forward": {"fold": 1.8, "pulse": 1.34, "calm": 1.32, "widest": 32, "pulse_days": 5, "least": 4.0},
}
#: What a long series adds to the source, by metric.
HINTS = {"pe_ttm": "companiesmarketcap-pe-ratio", "pb": "companiesmarketcap-pb-ratio", "pe_forward": "forward-series"}


def fold(a: Column, b: Column) -> Column:
    """How many times two values differ, either way round; negative where the signs do."""
    return F.greatest(a / b, b / a)


def series_shape(long: DataFrame, entity: str = "entity", date: str = "d") -> DataFrame:
    """(entity, metric, n, coarse, last date and value) of long series (entity, metric, date, value).

    Coarse: fewer than three rows, or a median of 120 days or more between dates.
    """
    w = W.partitionBy(entity, "metric").orderBy(date)
    gap = F.datediff(date, F.lag(date).over(w))
    rows = long.withColumn("__gap", F.when(gap > 0, gap))
    out = rows.groupBy(entity, "metric").agg(F.count(F.lit(1)).alias("n"), F.median("__gap").alias("__m"), F.max(date).alias("last_date"), F.max_by("value", date).alias("last_value"))
    return out.withColumn("coarse", (F.col("n") < 3) | F.coalesce(F.col("__m") >= COARSE_DAYS, F.lit(True))).drop("__m")


def other_basis(anchors: DataFrame, latest: DataFrame, shape: DataFrame, entity: str = "entity", date: str = "d") -> DataFrame:
    """Entities whose trailing anchors lie far from their own latest value, while a long series can stand in."""
    w = W.partitionBy(entity).orderBy(F.desc(date))
    good = anchors.select(entity, date, usable(F.col("pe_ttm")).alias("v")).where("v IS NOT NULL")
    mid = good.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= RECENT).groupBy(entity).agg(F.median("v").alias("__mid"))
    long = shape.where((F.col("metric") == "pe_ttm") & (F.col("n") >= ENOUGH)).select(entity)
    now = latest.select(entity, usable(F.col("pe_ttm")).alias("__now"))
    return mid.join(now, entity).join(long, entity).where(fold(F.col("__now"), F.col("__mid")) >= MISMATCH).select(entity)


def merge_payloads(
    anchors: DataFrame, latest: DataFrame, long: DataFrame, today: Column, divisors: dict[str, float] | None = None, entity: str = "entity", date: str = "d"
) -> tuple[DataFrame, DataFrame]:
    """A provider's anchors and latest values (with ``source``) merged with long series (entity, metric, date, value).

    Where both have a date, the series' value goes before the anchor's, unless the series is coarse: then it
    only fills. Trailing anchors of another basis are dropped first, spikes last. The latest value is the
    series' last one while that is fresh and not 3.2 times off the provider's, else the provider's (its
    trailing ratio divided by ``divisors`` for listings that need it), else the series'.
    Returns (entity, date, metrics) and (entity, metrics, source); entities with neither are left out.
    """
    shape = cut_lineage(series_shape(long, entity, date))
    wrong = other_basis(anchors, latest, shape, entity, date).withColumn("__wrong", F.lit(True))
    mine = anchors.where(F.col(date).isNotNull()).join(wrong, entity, "left")
    mine = mine.select(entity, date, *[F.when(F.col("__wrong").isNull() if m == "pe_ttm" else F.lit(True), usable(F.col(m))).alias(m) for m in METRICS])
    mine = mine.groupBy(entity, date).agg(*[F.max(m).alias(m) for m in METRICS])
    rows = long.join(shape.select(entity, "metric", "coarse"), [entity, "metric"])
    at = lambda m, coarse: F.max(F.when((F.col("metric") == m) & (F.col("coarse") == coarse), F.col("value")))
    wide = rows.groupBy(entity, date).agg(*[at(m, c).alias(f"__{m}_{k}") for m in HINTS for k, c in (("over", False), ("under", True))])
    both = mine.join(wide, [entity, date], "full")
    merged = both.select(entity, date, *[F.coalesce(f"__{m}_over", m, f"__{m}_under").alias(m) if m in HINTS else F.col(m) for m in METRICS])
    for m, how in SPIKES.items():
        merged = drop_spikes(merged.where(F.coalesce(*METRICS).isNotNull()), entity, date, m, **how)
    merged = merged.where(F.coalesce(*[usable(F.col(m)) for m in METRICS]).isNotNull())

    ends = shape.groupBy(entity).agg(*[F.max(F.when(F.col("metric") == m, F.struct("last_date", usable(F.col("last_value")).alias("v")))).alias(f"__{m}") for m in HINTS])
    now = latest.select(entity, "source", *[usable(F.col(m)).alias(m) for m in METRICS]).join(ends, entity, "full")
    if divisors:
        by = F.create_map(*[F.lit(x) for pair in divisors.items() for x in pair])
        now = now.withColumn("pe_ttm", F.col("pe_ttm") / F.coalesce(F.try_element_at(by, F.upper(F.trim(F.col(entity)))), F.lit(1.0)))
    pick = {}
    for m in HINTS:
        own, end = F.col(m), F.col(f"__{m}.v")
        fresh = F.datediff(today, F.col(f"__{m}.last_date")).between(0, FRESH_DAYS) & end.isNotNull()
        near = own.isNull() | (fold(own, end) < OUTLIER)
        pick[m] = F.when(F.coalesce(fresh & near, F.lit(False)), end).otherwise(F.coalesce(own, end))
    tags = F.concat_ws("+", F.when(F.col("source") != "", F.col("source")), *[F.when(F.col(f"__{m}").isNotNull(), F.lit(h)) for m, h in HINTS.items()])
    now = now.select(entity, *[pick.get(m, F.col(m)).alias(m) for m in METRICS], tags.alias("source"))
    some = merged.select(entity).distinct().withColumn("__some", F.lit(True))
    now = now.join(some, entity, "left").where(F.coalesce(*METRICS).isNotNull() | F.col("__some").isNotNull()).drop("__some")
    return merged, now


def read_in_stages(keys: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], key: str, enough: Column, score: Column) -> DataFrame:
    """For every key the first stage whose candidate is enough, else the best candidate of all.

    A stage takes the keys that are still open and gives one row a key (all stages the same columns); it should
    join its source to them, so that later providers are read for open keys only. A stage that finds no open
    key is not asked at all. Among candidates that are not enough the highest score wins, the earlier
    stage at a tie; without a positive score there is no row. Returns the candidate with its stage.
    """
    spark = keys.sparkSession
    open_, kept, done = cut_lineage(keys.select(key).distinct()), None, None
    for k, (name, read) in enumerate(stages):
        if open_.isEmpty():
            break
        rows = cut_lineage(read(open_).withColumns({"stage": F.lit(name), "__k": F.lit(k), "__ok": F.coalesce(enough, F.lit(False)), "__score": F.coalesce(score, F.lit(0)).cast("double")}))
        kept = rows if kept is None else kept.unionByName(rows)
        done = rows.where("__ok").select(key)
        open_ = cut_lineage(open_.join(done, key, "left_anti"))
    if kept is None:
        return spark.createDataFrame([], f"{key} string, stage string")
    best = W.partitionBy(key).orderBy(F.desc("__ok"), F.desc("__score"), "__k")
    return kept.where("__ok OR __score > 0").withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__k", "__ok", "__score")


#: The order in which alternative sources are asked, all others after them by name; anchors of history that do.
SOURCE_ORDER = ("fai", "nasdaq", "fmp", "spg")
ENOUGH_ANCHORS = 4


def source_rank(source: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), source)
    return F.struct(F.when(at > 0, at - 1).otherwise(99).cast("int").alias("place"), source.alias("name"))


def merge_in_order(anchors: DataFrame, latest: DataFrame, rank: str, entity: str = "entity", date: str = "d") -> tuple[DataFrame, DataFrame]:
    """Payloads merged metric by metric, the first in rank order going before; the source names all that had anything, in order."""
    first = lambda m: F.min(F.when(usable(F.col(m)).isNotNull(), F.struct(F.col(rank), usable(F.col(m)).alias("v"))))["v"].alias(m)
    some = F.coalesce(*[usable(F.col(m)) for m in METRICS]).isNotNull()
    rows = anchors.where(some).groupBy(entity, date).agg(*[first(m) for m in METRICS])
    tags = anchors.where(some).select(entity, rank, "tag").unionByName(latest.where(some).select(entity, rank, "tag")).distinct()
    tags = tags.groupBy(entity).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "tag"))), lambda x: x["tag"]), "+").alias("source"))
    return rows, tags.join(latest.groupBy(entity).agg(*[first(m) for m in METRICS]), entity, "left")


def collect_ratios(keys: DataFrame, open_rows: Callable[[DataFrame], tuple[DataFrame, DataFrame]], primary: tuple[DataFrame, DataFrame], entity: str = "entity", date: str = "d") -> tuple[DataFrame, DataFrame]:
    """Payloads of the primary source, and of its alternatives only for entities that still lack something.

    ``primary`` and what ``open_rows`` gives for the open entities are (anchors, latest) with columns source,
    period and the metrics. An entity of ``keys`` is open if the merged primary has no latest forward or growth ratio,
    or fewer than four anchors of either. Of the primary, quarterly rows go before annual ones; the
    alternatives' quarterly rows follow in ``SOURCE_ORDER``.
    """
    place = lambda df, own: df.withColumn(
        "__rank", F.struct(F.lit(0 if own else 1).alias("a"), (F.col("period") != "quarterly").cast("int").alias("b") if own else F.lit(0).alias("b"), source_rank(F.col("source")).alias("c"))
    ).withColumn("tag", F.concat_ws(":", "source", "period"))
    mine = [cut_lineage(place(df, True)) for df in primary]
    rows, now = merge_in_order(*mine, "__rank", entity, date)
    count = rows.groupBy(entity).agg(F.count("pe_forward").alias("__f"), F.count("peg").alias("__g"))
    lacking = keys.select(entity).distinct().join(now, entity, "left").join(count, entity, "left").where(
        F.col("pe_forward").isNull() | F.col("peg").isNull() | (F.coalesce("__f", F.lit(0)) < ENOUGH_ANCHORS) | (F.coalesce("__g", F.lit(0)) < ENOUGH_ANCHORS)
    )
    open_ = cut_lineage(lacking.select(entity))
    if open_.isEmpty():
        return rows, now
    more = [place(df.where("period = 'quarterly'"), False) for df in open_rows(open_)]
    return merge_in_order(*[a.unionByName(b.select(*a.columns)) for a, b in zip(mine, more)], "__rank", entity, date)
