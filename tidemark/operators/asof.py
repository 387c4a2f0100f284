"""As-of joins in both directions, as one union and one window: no range join, no cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_on: str,
    right_on: str,
    take: list[str],
    direction: str = "backward",
    before_first: str = "null",
    tolerance_days: int | None = None,
) -> DataFrame:
    """Each left row with the columns ``take`` of the nearest right row of the same key.

    ``backward`` takes the last right row at or before, ``forward`` the first at or after, ``nearest`` the
    closer of the two (backward at a tie). Rows beyond ``tolerance_days`` count as missing. With
    ``before_first`` = "first" ("last" forwards) rows without a match take the key's first (last) right
    row. Both sides are shuffled once on the key; right rows with null times are ignored. Of right rows
    at the same time the one with the largest values is taken.
    """
    columns = left.columns
    seen = F.struct(F.col("__at"), *[F.col(f"__r_{c}") for c in take])
    a = left.select(F.col(by).alias("__by"), F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.struct(*columns).alias("__left"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__r_{c}") for c in take])
    b = right.where(F.col(right_on).isNotNull()).select(
        F.col(by).alias("__by"), F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), *[F.col(c).alias(f"__r_{c}") for c in take]
    )
    rows = a.unionByName(b).withColumn("__seen", F.when(F.col("__side") == 0, seen))
    order = [F.col("__at"), F.col("__side"), *[F.col(f"__r_{c}") for c in take]]
    # Right rows come before left rows at the same time going back, and the other way round going forward.
    back = W.partitionBy("__by").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # Going forward is the same seen from the end: a growing frame, where a shrinking one is quadratic in Spark.
    ahead = W.partitionBy("__by").orderBy(F.col("__at").desc(), F.col("__side"), *[F.col(f"__r_{c}") for c in take]).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("__by").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = {"backward": F.last("__seen", True).over(back), "forward": F.last("__seen", True).over(ahead)}
    if direction == "nearest":
        rows = rows.withColumns({"__b": found["backward"], "__f": found["forward"]})
        gap = lambda x: F.abs(F.datediff(x["__at"], F.col("__at")))
        hit = F.when(F.col("__b").isNull() | (gap(F.col("__f")) < gap(F.col("__b"))), F.col("__f")).otherwise(F.col("__b"))
    else:
        hit = found[direction]
    rows = rows.withColumn("__hit", hit)
    if tolerance_days is not None:
        rows = rows.withColumn("__hit", F.when(F.abs(F.datediff(F.col("__hit.__at"), F.col("__at"))) <= tolerance_days, F.col("__hit")))
    if before_first != "null":
        edge = F.first("__seen", True) if before_first == "first" else F.last("__seen", True)
        rows = rows.withColumn("__hit", F.coalesce("__hit", edge.over(whole)))
    return rows.where("__side = 1").select("__left.*", F.col("__hit.__at").alias("asof_date"), *[F.col(f"__hit.__r_{c}").alias(c) for c in take])
