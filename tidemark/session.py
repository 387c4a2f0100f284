"""Session helpers: settings the library relies on, table loading, lineage cuts."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "tidemark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC, AQE and skew handling on; shuffle partitions stay with the cluster unless given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs it from a checkout.

    Arrow batches are cut to a thousand rows where the session has Spark's default of ten thousand:
    rows are whole texts here, and a worker holds a batch with all that is made from it.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def checkpoint_path(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``; a local one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that lost executors cost no recomputation."""
    checkpoint_path(df.sparkSession)
    return df.checkpoint()


def drop_table(spark: SparkSession, folder: str) -> None:
    """Remove a table that this package wrote under ``checkpoint_path`` and that nothing reads any more."""
    if not folder.startswith(checkpoint_path(spark) + "/"):
        raise ValueError(f"not a folder of its own: {folder}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
