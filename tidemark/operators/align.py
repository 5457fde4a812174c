"""Joins of series on time: aligned on buckets, and as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import time_bucket


def align(left: DataFrame, right: DataFrame, step: int, how: str = "inner", names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Averages of two series by bucket, joined on the bucket: both sides are aggregated before they move."""

    def means(points: DataFrame, name: str) -> DataFrame:
        return points.groupBy(time_bucket(F.lit(step), F.col("time")).alias("bucket")).agg(F.avg("value").alias(name))

    return means(left, names[0]).join(means(right, names[1]), "bucket", how)


def as_of(left: DataFrame, right: DataFrame, by: list[str] | None = None, slice_seconds: int = 86_400, tolerance: int | None = None) -> DataFrame:
    """left with time and value of the last point of right at or before it, as right_time and right_value.

    Both sides are merged by key and slice of time; within a slice a window carries the last point on, and the last point before
    the slice comes from the slices' own last points. So a long or hot series is spread over its slices. Ties go to the larger seq.
    """
    by = by or []
    slot = F.floor(F.col("time") / slice_seconds)
    r = right.select(*by, slot.alias("_slot"), "time", F.struct("time", F.col("seq").alias("seq"), "value").alias("_p"))
    inner = [c for c in left.columns]
    a = left.select(*by, slot.alias("_slot"), "time", F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_p"].dataType).alias("_p"), F.struct(*inner).alias("_row"))
    b = r.select(*by, "_slot", "time", F.lit(0).alias("_side"), "_p", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*by, "_slot").orderBy("time", "_side", F.col("_p.seq")).rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b).withColumn("_near", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    # one row for each slice: its last point, carried over the slices after it; null keys are keys
    ends = a.unionByName(b).groupBy(*by, "_slot").agg(F.max("_p").alias("_end"))
    past = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"_by{n}") for n, c in enumerate(by)], F.col("_slot").alias("_at"), F.last("_end", ignorenulls=True).over(past).alias("_old"))
    on = F.col("_slot") == F.col("_at")
    for n, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{n}"))
    out = merged.join(carried, on, "left").withColumn("_hit", F.coalesce("_near", "_old"))
    hit = F.col("_hit") if tolerance is None else F.when(F.col("time") - F.col("_hit.time") <= tolerance, F.col("_hit"))
    return out.select("_row.*", hit["time"].alias("right_time"), hit["value"].alias("right_value"))
