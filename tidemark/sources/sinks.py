"""Sinks: partitioned series, snapshots, nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_series(points: DataFrame, path: str, by: str = "entity") -> None:
    """One folder per entity; overwriting drops the folders of entities that are gone."""
    points.repartition(by).sortWithinPartitions(by, "d").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)


def refresh_series(points: DataFrame, path: str, by: str = "entity") -> None:
    """Replaces the folders of the entities given and leaves all others."""
    points.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def stale_entities(stored: DataFrame, valid: DataFrame, by: str = "entity") -> DataFrame:
    """Entities in store that the new catalogue does not have."""
    return stored.select(by).distinct().join(valid.select(by), by, "left_anti")


def nested_store(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, rows): each key's rows as one sorted array, empties left out."""
    rest = [order, *[c for c in rows.columns if c not in (key, order)]]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows")).where(F.size("rows") > 0)


def build_summary(points: DataFrame, date: str = "d") -> DataFrame:
    return points.agg(F.coalesce(F.max(date).cast("string"), F.lit("n/a")).alias("last_date"), F.count(F.lit(1)).alias("n_points"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_stores(stores: dict[str, DataFrame], path: str) -> None:
    """Each store under its name; a store is replaced as a whole."""
    for name, df in stores.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
