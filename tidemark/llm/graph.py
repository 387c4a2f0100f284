"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_groups
from tidemark.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Every node of a long-typed edge list with the smallest node of its component: (node, root).

    Alternates large-star and small-star steps until the edges stay the same; the number of rounds grows
    with the logarithm of the graph's size. Each round's edges are written to the checkpoint folder.
    Hubs are joined by broadcast (there are under a thousand), so no task holds all edges of a hub.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut_lineage(e)
    seen = _mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = join_groups(both, low, ["u"], "degree", 2 * seen[0], F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        rest = join_groups(large, low, ["u"], "degree", seen[0], F.col("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
