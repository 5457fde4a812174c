"""Newline-delimited JSON points: {series, ts, value?, fields?, tags?}.

`value` missing: the first numeric entry of `fields`, else 0. A `value` that is no number counts as 0. Lines that do not parse, and
lines without series or ts, are skipped. `fields` and `tags` are read as text, which keeps their key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .points import COLUMNS
from .series import series_ids

LINE = "series string, ts string, value string, fields string, tags string, _corrupt_record string"
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def compact_json(c: Column) -> Column:
    """A JSON object's text without white space between its parts, key order kept."""
    return F.to_json(F.from_json(c, "map<string,string>"))


def normalise(lines: DataFrame) -> DataFrame:
    """Points from parsed lines; seq orders the lines of one read (in a stream it is 0, and the batches' writer sets it)."""
    good = lines.where(F.col("_corrupt_record").isNull() & F.col("series").isNotNull() & F.expr("try_cast(ts as bigint)").isNotNull())
    fields = F.map_values(F.from_json("fields", "map<string,string>"))
    first = F.get(F.filter(F.transform(fields, lambda x: x.try_cast("double")), lambda x: x.isNotNull()), 0)
    value = F.when(F.col("value").isNotNull(), F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))).otherwise(F.coalesce(first, F.lit(0.0)))
    tags = F.coalesce(compact_json(F.col("tags")), F.lit("{}"))
    out = good.select("series", tags.alias("_tags"), F.col("ts").cast("bigint").alias("time"), value.alias("value"))
    return out.select(
        series_ids("series", "_tags").alias("series_id"),
        "series",
        F.coalesce(F.from_json("_tags", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("tags"),
        "time",
        "value",
        (F.lit(0).cast("bigint") if lines.isStreaming else F.monotonically_increasing_id()).alias("seq"),
    ).select(*COLUMNS)


def read(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.schema(LINE).options(**OPTIONS).json(path))


def parse_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Points from a DataFrame with one JSON line in each row, as a stream of text has them."""
    parsed = F.from_json(F.col(column), LINE, OPTIONS)
    return normalise(lines.where(F.length(F.trim(F.col(column))) > 0).select(parsed.alias("_p")).select("_p.*"))


def generated(spark: SparkSession, rows: int = 10_000, start: int = 1_694_300_000, step: int = 10, series: str = "weather.room1") -> DataFrame:
    """The load generator's lines: value 20 + (i % 100) / 10 every `step` seconds."""
    return spark.range(rows).select(F.lit(series).alias("series"), (F.lit(start) + F.col("id") * step).alias("ts"), (20 + F.pmod("id", F.lit(100)) / 10).alias("value"))
