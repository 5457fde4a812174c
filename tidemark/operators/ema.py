"""Exponential moving averages over series of any length.

e0 = v0, e_i = alpha * v_i + q * e_(i-1), q = 1 - alpha. Points are cut into slices of time, and within a slice into runs of at most
`RUN` values, so short that 1 / q^RUN stays a number. Within a run e_i = q^(i+1) * e + q^i * sum(alpha * v_j / q^j), a running sum, where
e is the average before the run. A run as a whole takes e to a * e + b; these pairs, one for each run, are scanned in order in one
pass, and joined back. No task sorts or gathers a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slices import SLICE, slot

RUN = 1_000


def ema(df: DataFrame, value: str, alpha: float, keys: list[str], order: list[str], out: str, run: int = RUN, size: int = SLICE) -> DataFrame:
    """df with the average in `out`; null values are skipped and carry the average on. The first of `order` is a time."""
    q = 1.0 - alpha
    if q <= 0:
        run = 1
    elif q < 1:
        run = max(1, min(run, int(200 / -math.log10(q))))
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value).cast("double")
    df0 = df.withColumn("_slot", slot(order[0], size)).withColumn("_held", F.count(v).over(inside))
    # rows before a slice's first value belong to a run of their own, -1
    df0 = df0.withColumn("_run", F.floor((F.col("_held") - 1) / run)).withColumn("_i", F.when(F.col("_held") > 0, (F.col("_held") - 1) % run).otherwise(-1))
    within = Window.partitionBy(*keys, "_slot", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    term = alpha * v * F.pow(F.lit(q), -F.col("_i")) if q > 0 else alpha * v
    rows = df0.withColumn("_sum", F.coalesce(F.sum(term).over(within), F.lit(0.0)))
    scale = F.pow(F.lit(q), F.col("_i")) if q > 0 else F.lit(1.0)
    first = F.min_by(v, F.when(v.isNotNull(), F.struct(*order)))
    runs = rows.groupBy(*keys, "_slot", "_run").agg(F.max("_i").alias("_last"), first.alias("_first"), F.max_by(scale * F.col("_sum"), F.struct(*order)).alias("_b"))
    runs = runs.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_slot", "_run", "_first", F.pow(F.lit(q), F.col("_last") + 1).alias("_a"), "_b")
    names = [f"_k{n}" for n in range(len(keys))]
    spread = runs.repartition(*names) if names else runs.repartition(1)
    spread = spread.sortWithinPartitions(*names, "_slot", "_run")
    carried = spread.mapInArrow(_scan(len(names)), spread.select(*names, "_slot", "_run", F.col("_b").alias("_before")).schema)
    on = (F.col("r._slot") == F.col("c._slot")) & (F.col("r._run") == F.col("c._run"))
    for n, k in enumerate(keys):
        on = on & F.col(f"r.`{k}`").eqNullSafe(F.col(f"c._k{n}"))
    both = rows.alias("r").join(carried.alias("c"), on)
    e = F.when(F.col("_i") < 0, F.col("_before")).otherwise(F.pow(F.lit(q), F.col("_i") + 1) * F.col("_before") + scale * F.col("_sum"))
    return both.select(*[F.col(f"r.`{c}`").alias(c) for c in df.columns], e.alias(out))


def _scan(n: int):
    """Of each run, the average before it; the first value of a key stands for it before its first run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, e = None, None
        for batch in batches:
            before = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True) if n else ((),) * batch.num_rows
            for key, number, first, a, b in zip(keys, *(batch.column(c).to_pylist() for c in ("_run", "_first", "_a", "_b")), strict=True):
                if key != at or at is None:
                    at, e = key, None
                if number < 0:
                    before.append(e)
                    continue
                e = first if e is None else e
                before.append(e)
                e = a * e + b
            kept = [batch.column(i) for i in range(n)] + [batch.column("_slot"), batch.column("_run"), pa.array(before, pa.float64())]
            yield pa.record_batch(kept, names=[*batch.schema.names[:n], "_slot", "_run", "_before"])

    return run
