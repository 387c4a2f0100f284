"""Data-quality checks of a points table, as counts of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def violations(points: DataFrame, catalogue: DataFrame, metrics: list[str], entity: str = "entity", date: str = "d") -> DataFrame:
    """(rule, entity, n) for every rule an entity breaks: unknown id, missing date, descending date, non-finite metric.

    Rows come in an arrival order given by column ``seq``; dates may repeat but not go back.
    """
    known = catalogue.select(F.col(entity), F.lit(True).alias("__known")).distinct()
    w = W.partitionBy(entity).orderBy("seq")
    df = points.join(known, entity, "left").withColumn("__back", F.col(date) < F.lag(date).over(w))
    bad = lambda m: F.col(m).isNull() | F.isnan(m) | (F.abs(F.col(m)) == float("inf"))
    tests = {"unknown_id": F.col("__known").isNull(), "missing_date": F.col(date).isNull(), "descending_date": F.coalesce("__back", F.lit(False))}
    tests |= {f"not_finite_{m}": bad(m) for m in metrics}
    counts = df.groupBy(entity).agg(*[F.count_if(t).alias(r) for r, t in tests.items()])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in tests])
    return counts.select(entity, F.inline(rows)).where("n > 0")


def missing_entities(points: DataFrame, catalogue: DataFrame, entity: str = "entity") -> DataFrame:
    """Catalogue entries without a point."""
    return catalogue.join(points.select(entity).distinct(), entity, "left_anti")


def require_clean(found: DataFrame) -> None:
    """Raises with the first violations if there are any."""
    some = found.limit(5).collect()
    if some:
        raise ValueError("; ".join(f"{r['rule']} x {r['n']} in {r[0]}" for r in some))


def usable_history(points: DataFrame, least_points: int, entity: str = "entity", date: str = "d") -> DataFrame:
    """Entities with enough distinct dates to be reused."""
    return points.groupBy(entity).agg(F.count_distinct(date).alias("n_points")).where(F.col("n_points") >= least_points)

