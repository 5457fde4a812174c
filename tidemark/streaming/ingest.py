"""Continuous ingest and windowed aggregates with Structured Streaming."""

from __future__ import annotations

import hashlib
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ndjson
from ..sources.points import POINTS
from ..sources.storage import Store


def lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Points from the JSON files that arrive in a folder."""
    raw = spark.readStream.schema(ndjson.LINE).options(**ndjson.OPTIONS).option("maxFilesPerTrigger", max_files).json(path)
    return ndjson.normalise(raw)


def into_store(points: DataFrame, store: Store, checkpoint: str, every: str = "2 seconds", once: bool = False, source: str | None = None) -> StreamingQuery:
    """Adds every micro-batch to the store, once. Late points go to their own hour; compaction keeps the last written.

    `source` names the stream for that; without one its checkpoint does.
    seq is 2^40 times the batch's number plus the row's place in the batch, so that the last written wins; no two rows share one.
    """
    source = source or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_id", F.monotonically_increasing_id()).persist()
        part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
        sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a task
        starts = list(accumulate((sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)), initial=0))
        before = F.get(F.lit(starts).cast("array<bigint>"), part.cast("int"))
        store.append_once(rows.withColumn("seq", F.lit(epoch) * F.lit(1 << 40) + before + place).drop("_id"), source, epoch)
        rows.unpersist()

    writer = points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stored_points(spark: SparkSession, store: Store) -> DataFrame:
    """The store's files as a stream."""
    return spark.readStream.schema(f"{POINTS}, namespace string, hour_bucket bigint").parquet(store.path)


def without_repeats(points: DataFrame, late: str = "1 hour") -> DataFrame:
    """Drops repeats of a series' time that arrive within the watermark."""
    return points.withColumn("_at", F.timestamp_seconds("time")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["series_id", "time"])


def windowed(points: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling, or with `slide` sliding, aggregates of each series by event time."""
    at = points.withColumn("_at", F.timestamp_seconds("time")).withWatermark("_at", late)
    return _summary(at.groupBy("series", F.window("_at", size, slide) if slide else F.window("_at", size)))


def sessions(points: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Aggregates of each series by sessions that a gap in event time ends."""
    at = points.withColumn("_at", F.timestamp_seconds("time")).withWatermark("_at", late)
    return _summary(at.groupBy("series", F.session_window("_at", gap).alias("window")))


def _summary(grouped) -> DataFrame:
    made = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
    return made.select("series", F.unix_seconds("window.start").alias("start"), F.unix_seconds("window.end").alias("end"), "n", "avg", "min", "max")
