"""Points from CSV files, and tables of results as CSV, JSON or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .points import COLUMNS
from .series import series_ids


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Points from columns series, ts, value; rows without series or a whole-number ts go, a value that is no number counts as 0."""
    raw = spark.read.schema("series string, ts string, value string").csv(path, header=header)
    rows = raw.where("series is not null and try_cast(ts as bigint) is not null")
    return rows.select(
        series_ids("series", F.lit("{}")).alias("series_id"),
        "series",
        F.create_map().cast("map<string,string>").alias("tags"),
        F.col("ts").cast("bigint").alias("time"),
        F.coalesce(F.expr("try_cast(value as double)"), F.lit(0.0)).alias("value"),
        F.monotonically_increasing_id().alias("seq"),
    ).select(*COLUMNS)


def write_result(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    if kind not in ("parquet", "json", "csv", "orc"):
        raise ValueError(f"unknown kind of file {kind}")
    df.write.format(kind).mode(mode).option("header", "true").save(path) if kind == "csv" else df.write.format(kind).mode(mode).save(path)
