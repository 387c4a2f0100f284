"""Readers for landed JSON and CSV files, with explicit schemas and defaults for what is missing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "date string, pe_ttm double, pe_forward double, pb double, peg double, us10y_yield double"
DATASET = f"generatedAt string, source string, indices array<struct<id:string,symbol:string,`group`:string,displayName:string,description:string,rank:int,marketCap:double,forwardStartDate:string,points:array<struct<{', '.join(x.strip().replace(' ', ':') for x in POINT.split(','))}>>>>"
STORE = "generatedAt string, symbols map<string,array<struct<date:string,pe_ttm:double,pe_forward:double,pb:double,peg:double,source:string,capturedAt:string>>>"
CLOSES = "date string, open double, high double, low double, close double"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents; a missing path gives an empty table, a corrupt one a row of nulls."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], T._parse_datatype_string(schema))


def entities_and_points(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A dataset document as its catalogue and its long table of points; entries without id or points go."""
    e = docs.select("generatedAt", "source", F.inline("indices")).where(F.col("id").isNotNull() & (F.size("points") > 0))
    names = e.select(F.trim("id").alias("id"), F.upper(F.trim("symbol")).alias("symbol"), "group", "displayName", "description", F.coalesce("rank", F.lit(9999)).alias("rank"), F.coalesce("marketCap", F.lit(0.0)).alias("marketCap"), F.to_date("forwardStartDate").alias("forwardStartDate"), F.size("points").cast("long").alias("point_count"))
    points = e.select(F.trim("id").alias("id"), F.inline("points")).withColumn("date", F.to_date("date"))
    return names, points


def provider_snapshots(docs: DataFrame) -> DataFrame:
    """A snapshot store as rows, the last captured of each symbol and date."""
    from tidemark.operators.merge import keep_best

    rows = docs.select(F.explode("symbols").alias("symbol", "rows")).select("symbol", F.inline("rows")).withColumn("date", F.to_date("date"))
    return keep_best(rows, ["symbol", "date"], F.desc("capturedAt"), F.desc("source"))


def close_csv(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Daily closes of a date range; the range and the positive closes are filters for the scan."""
    df = spark.read.schema(CLOSES).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return df.where(F.col("date").between(start, end) & (F.col("close") > 0)).select(F.to_date("date").alias("date"), "close")


def yield_csv(spark: SparkSession, path: str) -> DataFrame:
    """Observation dates with a per cent rate, a dot where it is missing, as fractions."""
    df = spark.read.schema("date string, rate double").option("header", True).option("nullValue", ".").csv(path)
    return df.where("rate is not null").select(F.to_date("date").alias("date"), (F.col("rate") / 100).alias("us10y_yield"))


def metric_csv(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    df = spark.read.schema("date string, value double").option("header", True).csv(path)
    return df.where((F.col("value") > low) & (F.col("value") < high)).select(F.to_date("date").alias("date"), "value")


def first_existing(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first path that has rows."""
    for p in paths:
        df = read_json(spark, p, schema)
        if not df.isEmpty():
            return df
    return spark.createDataFrame([], T._parse_datatype_string(schema))


#: The runtime stores and their columns.
STORES = {
    "watchlists": "user_id string, watch_ids array<string>, upper double, lower double, cooldown int",
    "alerts": "user_id string, entity string, d date, direction string, severity string, percentile double, alert_id string, read boolean",
    "alert_state": "user_id string, entity string, last_triggered date, last_direction string",
}


def load_stores(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stores under a path; one that was never written is empty."""
    out = {}
    for name, schema in STORES.items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
        except AnalysisException:
            out[name] = spark.createDataFrame([], schema)
    return out
