"""The runtime stores as versioned tables: daily runs and acknowledgements as incremental merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import alerts as al
from tidemark.session import cut_lineage
from tidemark.sources import versions
from tidemark.sources.readers import STORES

#: Buckets of users. A run rewrites the buckets of users with news; the manifest names the rest by their older versions.
BUCKETS = 16


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Watchlists, alerts and alert state as last published; empty before the first run."""
    manifest = versions.read_manifest(spark, root)
    return {name: versions.read_table(spark, root, manifest, name, schema) for name, schema in STORES.items()}


def _publish(spark: SparkSession, root: str, manifest: dict, changed: dict[str, tuple[DataFrame, list[int] | None]], run: str) -> dict:
    version = manifest.get("version", 0) + 1
    parts = {name: versions.stage_table(spark, root, manifest, name, rows, "user_id", version, BUCKETS, touched) for name, (rows, touched) in changed.items()}
    new = {"version": version, "runs": [*manifest.get("runs", []), run][-100:], "tables": manifest.get("tables", {}) | parts}
    versions.swap_manifest(spark, root, new)
    return new


def _touched(rows: DataFrame) -> list[int]:
    """The buckets of the users of ``rows``: at most ``BUCKETS`` numbers."""
    return [r.b for r in rows.select(versions.bucket_of("user_id", BUCKETS).alias("b")).distinct().collect()]


def put_watchlists(spark: SparkSession, root: str, lists: DataFrame, run: str) -> dict:
    """Sets the lists of the users given and leaves all others."""
    manifest = versions.read_manifest(spark, root)
    if run in manifest.get("runs", []):
        return manifest
    old = load(spark, root)["watchlists"]
    users = lists.select("user_id").distinct()
    rows = cut_lineage(old.join(users, "user_id", "left_anti").unionByName(lists.select(*old.columns)))
    touched = _touched(users)
    return _publish(spark, root, manifest, {"watchlists": (rows.where(versions.bucket_of("user_id", BUCKETS).isin(touched)), touched)}, run)


def run_update(spark: SparkSession, root: str, ranked: DataFrame, run: str, percentile: str = "percentile", most: int = 500) -> dict:
    """One daily run over series with percentiles: new alerts merged into the stored ones, state carried on.

    The rules are those of the stored watchlists. A run that is published already changes nothing; one
    that failed before is repeated from the same stores, as nothing it wrote is named by the manifest.
    Alerts have ids made of their keys, so an alert is never stored twice, and stored ones keep ``read``.
    """
    manifest = versions.read_manifest(spark, root)
    if run in manifest.get("runs", []):
        return manifest
    stores = load(spark, root)
    watchers = stores["watchlists"].select("user_id", F.explode("watch_ids").alias("entity"), "upper", "lower", "cooldown")
    fired, state = al.latest_alerts(ranked, watchers, stores["alert_state"], percentile, most=most)
    fired, state = cut_lineage(fired.withColumn("percentile", F.round("percentile", 4))), cut_lineage(state)
    touched = _touched(fired)
    mine = stores["alerts"].where(versions.bucket_of("user_id", BUCKETS).isin(touched))
    merged = cut_lineage(al.merge_alerts(mine, fired, most=most))
    return _publish(spark, root, manifest, {"alerts": (merged, touched), "alert_state": (state, None)}, run)


def put_state(spark: SparkSession, root: str, state: DataFrame, run: str) -> dict:
    """Replaces the alert state, as a correction by hand does."""
    manifest = versions.read_manifest(spark, root)
    if run in manifest.get("runs", []):
        return manifest
    return _publish(spark, root, manifest, {"alert_state": (cut_lineage(state), None)}, run)


def acknowledge(spark: SparkSession, root: str, user: str, run: str, ids: list[str] | None = None) -> dict:
    """Marks a user's alerts as read, all or those listed; only that user's bucket is rewritten."""
    manifest = versions.read_manifest(spark, root)
    if run in manifest.get("runs", []):
        return manifest
    alerts = load(spark, root)["alerts"]
    touched = _touched(spark.createDataFrame([(user,)], "user_id string"))
    mine = alerts.where(versions.bucket_of("user_id", BUCKETS).isin(touched))
    return _publish(spark, root, manifest, {"alerts": (cut_lineage(al.acknowledge(mine, user, ids)), touched)}, run)
