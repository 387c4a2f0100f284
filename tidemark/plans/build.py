"""The dataset build: staged beside the published versions, entity by entity, published as a whole or not at all."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import violations
from tidemark.session import cut_lineage
from tidemark.sources import versions

#: Closes that a live series needs, and the tags of a dataset's source.
LEAST_CLOSES, LIVE, FALLBACK, NO_LIVE, SYNTHETIC = 120, "free-live-proxy-v6", "history-fallback-", "no-live-refresh", "(?i)synthetic"


class BuildFailed(Exception):
    """Nothing was published; ``reasons`` has (entity, reason) for every entity that neither the build nor history could give."""

    def __init__(self, reasons: list[tuple[str, str]]):
        super().__init__(f"no data for {len(reasons)} of the catalogue: " + " | ".join(f"{e}: {r}" for e, r in reasons[:20]))
        self.reasons = reasons


@dataclass
class Rules:
    """What makes a series usable: its metrics, the metric that no series may lack altogether, and peaks that history must show.

    ``peaks`` has (entity, first, last, metric floor): history without a value of ``peak_metric`` that high
    between those dates is not reliable.
    """

    metrics: tuple[str, ...]
    needed: str
    peak_metric: str
    peaks: DataFrame | None = None
    least_closes: int = LEAST_CLOSES


def versions_of(manifest: dict) -> list[dict]:
    """Published versions, newest first: number, source, end date."""
    return sorted(manifest.get("versions", []), key=lambda v: -v["version"])


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The points of a published version, by default the newest."""
    manifest = versions.read_manifest(spark, root)
    about = next(v for v in versions_of(manifest) if version in (None, v["version"]))
    return _points(spark, root, about)


def _points(spark: SparkSession, root: str, about: dict) -> DataFrame:
    # With its schema: names of folders are entities, never numbers or dates.
    return spark.read.schema(T.StructType.fromJson(about["schema"])).parquet(f"{root}/points/v{about['version']}")


def read_entities(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    manifest = versions.read_manifest(spark, root)
    return spark.read.parquet(f"{root}/entities/v{version or versions_of(manifest)[0]['version']}")


def live_status(live: DataFrame, catalogue: DataFrame, rules: Rules) -> DataFrame:
    """(entity, reason, hard): for every entity of the catalogue why its new series cannot be taken, null if it can.

    A series that lacks the needed metric altogether fails hard: history must not stand in for it. All other
    reasons (too few points, unknown id, dates that go back, values that are not finite) are soft.
    """
    found = violations(live, catalogue, list(rules.metrics))
    broken = found.where(F.col("rule") != F.lit(f"not_finite_{rules.needed}")).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("rule")), "+").alias("broken"))
    usable = F.col(rules.needed).isNotNull() & ~F.isnan(rules.needed) & (F.abs(rules.needed) < float("inf"))
    size = live.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("n_needed"))
    df = catalogue.select("entity").join(size, "entity", "left").join(broken, "entity", "left")
    hard = F.coalesce((F.col("n") >= rules.least_closes) & (F.col("n_needed") == 0), F.lit(False))
    partly = F.when(F.col("n_needed") < F.col("n"), F.lit(f"not_finite_{rules.needed}"))
    reason = F.when(F.coalesce("n", F.lit(0)) < rules.least_closes, "insufficient closes").when(hard, F.lit(f"missing {rules.needed}")).otherwise(F.coalesce("broken", partly))
    return df.select("entity", reason.alias("reason"), hard.alias("hard"))


def last_good(spark: SparkSession, root: str, wanted: DataFrame, end: str, rules: Rules) -> DataFrame | None:
    """(entity, from_version, points...) of the newest version in which each wanted entity's history is reliable.

    Versions with a synthetic source do not count; a version that is unusable for one entity is passed over
    for that entity only. None without any usable version. Points after ``end`` are left out before a series is judged. Versions are
    partitioned by entity, so only the folders of the wanted ones are read.
    """
    usable = [v for v in versions_of(versions.read_manifest(spark, root)) if v["source"] and not re.search(SYNTHETIC, v["source"])]
    if not usable:
        return None
    read = [_points(spark, root, v).withColumn("from_version", F.lit(v["version"])) for v in usable]
    rows = read[0]
    for r in read[1:]:
        rows = rows.unionByName(r)
    rows = rows.join(wanted.select("entity"), "entity", "left_semi").where(F.col("d") <= F.lit(end).cast("date"))
    good = rows.select("entity", "from_version").distinct()
    if rules.peaks is not None:
        peak = rows.join(rules.peaks, "entity").where(F.col("d").between(F.col("first"), F.col("last")))
        peak = peak.groupBy("entity", "from_version").agg(F.max(rules.peak_metric).alias("__peak"), F.first("floor").alias("floor"))
        good = good.join(rules.peaks.select("entity", F.lit(True).alias("__asked")), "entity", "left").join(peak, ["entity", "from_version"], "left")
        good = good.where(F.col("__asked").isNull() | F.coalesce(F.col("__peak") >= F.col("floor"), F.lit(False)))
    newest = good.groupBy("entity").agg(F.max("from_version").alias("from_version"))
    return rows.join(newest, ["entity", "from_version"], "left_semi")


def build_dataset(spark: SparkSession, root: str, live: DataFrame, catalogue: DataFrame, end: str, rules: Rules, tags: tuple[str, ...] = ()) -> dict:
    """Builds, checks and publishes a version; gives its manifest, or raises ``BuildFailed`` and leaves the published one.

    ``live`` has the new points (entity, d, seq, metrics), ``catalogue`` the entities that a dataset must
    have. Each entity's new series is taken if nothing speaks against it. Where it fails softly, its last good
    version stands in; where it fails hard, or has no history, the build fails, with all such entities
    named. Points and entities are staged in folders of their own; the one rename of the manifest
    publishes both. A repeated build overwrites what a failed one has staged.
    """
    manifest = versions.read_manifest(spark, root)
    version = manifest.get("version", 0) + 1
    status = cut_lineage(live_status(live, catalogue, rules))
    columns = ["entity", "d", *rules.metrics]
    rows = live.join(status.where("reason IS NULL").select("entity"), "entity", "left_semi").select(*columns).withColumn("from_version", F.lit(version))
    soft = status.where("reason IS NOT NULL AND NOT hard")
    history = last_good(spark, root, soft, end, rules)
    if history is not None:
        rows = rows.unionByName(history.select(*columns, "from_version"))
    points, entities = f"{root}/points/v{version}", f"{root}/entities/v{version}"
    rows.repartition("entity").sortWithinPartitions("entity", "d").write.mode("overwrite").partitionBy("entity").parquet(points)
    staged = spark.read.schema(rows.schema).parquet(points)
    made = staged.groupBy("entity").agg(F.max("from_version").alias("from_version"), F.count(F.lit(1)).alias("n_points"), F.max("d").alias("last_date"))
    made = cut_lineage(status.join(made, "entity", "left").withColumn("origin", F.when(F.col("from_version") == version, "live").when(F.col("from_version").isNotNull(), "history")))
    # One row an entity of the catalogue that failed: what the message names.
    reasons = [(r.entity, r.reason) for r in made.where("origin IS NULL").orderBy("entity").collect()]
    if reasons:
        versions.remove(spark, points)
        raise BuildFailed(reasons)
    made.write.mode("overwrite").parquet(entities)
    n = {r.origin: r["count"] for r in made.groupBy("origin").count().collect()}
    parts = [LIVE, *([f"{FALLBACK}{n['history']}"] if n.get("history") else []), *([] if n.get("live") else [NO_LIVE]), *tags]
    about = {"version": version, "source": "+".join(parts), "end": end, "schema": rows.select("d", *rules.metrics, "from_version", "entity").schema.jsonValue()}
    manifest = {"version": version, "versions": [*manifest.get("versions", []), about]}
    versions.swap_manifest(spark, root, manifest)
    return manifest

