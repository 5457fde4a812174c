"""Gap filling over a grid of time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 10_000_000


def grid(df: DataFrame, bucket: str, step: int, keys: list[str], max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """df with a row for every bucket between the first and the last of its keys; new rows have nulls.

    A grid of more than `max_buckets` a key raises. Each key's grid is made where its bounds are, from two numbers.
    """
    bounds = df.groupBy(*keys).agg(F.min(bucket).alias("_low"), F.max(bucket).alias("_high")) if keys else df.agg(F.min(bucket).alias("_low"), F.max(bucket).alias("_high")).where("_low is not null")
    size = (F.col("_high") - F.col("_low")) / step + 1
    steps = F.when(size <= max_buckets, F.sequence("_low", "_high", F.lit(step).cast("bigint"))).otherwise(F.raise_error(F.lit(f"the grid has more than {max_buckets} buckets")).cast("array<bigint>"))
    full = bounds.select(*keys, F.explode(steps).alias(bucket))
    renamed = df.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, bucket) else F.col(c) for c in df.columns])
    on = full[bucket] == renamed[f"_r_{bucket}"]
    for k in keys:
        on = on & full[k].eqNullSafe(renamed[f"_r_{k}"])
    joined = full.join(renamed, on, "left")
    return joined.select(*[full[c] if c in (*keys, bucket) else F.col(c) for c in df.columns])


def fill(df: DataFrame, bucket: str, step: int, keys: list[str], values: list[str], kind: str, constant: Column | None = None) -> DataFrame:
    """The whole grid, its empty values filled: null, previous, linear or constant. Edges of `linear` stay null."""
    full = grid(df, bucket, step, keys)
    if kind == "null":
        return full
    if kind == "constant":
        return full.withColumns({v: F.coalesce(F.col(v), constant.cast(full.schema[v].dataType)) for v in values})
    by = Window.partitionBy(*keys).orderBy(bucket)
    up, down = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    if kind == "previous":
        return full.withColumns({v: F.last(v, ignorenulls=True).over(up) for v in values})
    out = {}
    for v in values:
        at = F.when(F.col(v).isNotNull(), F.struct(F.col(bucket).alias("t"), F.col(v).cast("double").alias("v")))
        a, b = F.last(at, ignorenulls=True).over(up), F.first(at, ignorenulls=True).over(down)
        between = a["v"] + (b["v"] - a["v"]) * (F.col(bucket) - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0))
        out[v] = F.when(F.col(v).isNotNull(), F.col(v).cast("double")).otherwise(between)
    return full.withColumns(out)
