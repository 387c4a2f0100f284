"""Versioned tables under one manifest: staged side by side, published by one rename."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def read_manifest(spark: SparkSession, root: str) -> dict:
    """The published manifest, empty before the first publication."""
    path = _path(spark, f"{root}/manifest.json")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(path.toString()).collect()))


def swap_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    """Publishes ``manifest``: readers see the old one or the new one, never a part.

    Whatever a failed run has staged stays unseen, as only the manifest names what counts.
    """
    conf, rename = spark._jsc.hadoopConfiguration(), getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    new = _path(spark, f"{root}/manifest-{uuid4().hex}.tmp")
    fs = new.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(new, _path(spark, f"{root}/manifest.json"), how)


def remove(spark: SparkSession, path: str) -> None:
    p = _path(spark, path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, root: str, manifest: dict, name: str, schema: str) -> DataFrame:
    """A bucketed table as the manifest has it: each bucket from the version that wrote it last; empty if never written."""
    parts = manifest.get("tables", {}).get(name, {})
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{name}/v{v}/bucket={b}" for b, v in parts.items()])


def stage_table(spark: SparkSession, root: str, manifest: dict, name: str, rows: DataFrame, key: str, version: int, buckets: int, touched: list[int] | None = None) -> dict[str, int]:
    """Writes the buckets of ``rows`` as one version and gives the table's new parts; only ``touched`` buckets are replaced if given.

    A bucket that was touched and has no rows any more is dropped. The version's folder is overwritten, so
    a run that failed before publication can be repeated.
    """
    path = f"{root}/{name}/v{version}"
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    p = _path(spark, path)
    found = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    written = {f.split("=")[1]: version for f in found if f.startswith("bucket=")}
    old = manifest.get("tables", {}).get(name, {})
    keep = {} if touched is None else {b: v for b, v in old.items() if int(b) not in touched}
    return keep | written
