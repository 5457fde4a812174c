"""Rollups: pre-aggregated buckets, and their choice when a query is planned."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import AGGREGATES, WINDOWS
from ..functions.scalars import time_bucket
from .builder import Bounds, Planner, Scope, _folded, _same, constant, time_bounds
from .checks import buckets, calls
from .language import Binary, Between, Call, Expr, Literal, Name, Select, Unary

#: Aggregates of `value` that a rollup's columns can give, over rows of partial ones.
MERGED = {
    "sum": lambda: F.sum("sum"),
    "count": lambda: F.sum("n"),
    "rows": lambda: F.sum("points"),
    "min": lambda: F.min("min"),
    "max": lambda: F.max("max"),
    "avg": lambda: F.sum("sum") / F.nullif(F.sum("n"), F.lit(0)),
}


def build(points: DataFrame, step: int) -> DataFrame:
    """One row for each series and bucket: bucket, number of points, and sum, n, min, max of the values that are not null."""
    return points.groupBy("series_id", "series", time_bucket(F.lit(step), F.col("time")).alias("bucket")).agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("sum"), F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))


def coarser(rollup: DataFrame, step: int) -> DataFrame:
    """A rollup from a finer one whose step divides `step`."""
    return rollup.groupBy("series_id", "series", time_bucket(F.lit(step), F.col("bucket")).alias("bucket")).agg(F.sum("points").alias("points"), F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))


@dataclass
class Rollups:
    """Rollup tables by their step in seconds."""

    tables: dict[int, DataFrame] = field(default_factory=dict)
    used: int | None = None

    def plan(self, planner: Planner, s: Select) -> DataFrame | None:
        """The query over the coarsest fitting rollup; None if none gives the same rows.

        It fits if its step divides the bucket, every aggregate is a mergeable one of `value`, nothing but the bucket is grouped by,
        and the predicate only bounds time at the step's edges.
        """
        self.used = None
        found = buckets(s)
        if len(s.group) != 1 or not found or len(found[0].args) != 2:
            return None
        wanted = list({_folded(c): c for e in (*[i.expr for i in s.items], *[o.expr for o in s.order]) for c in calls(e, AGGREGATES)}.values())
        if any(c.name.lower() not in MERGED or c.args and not _same(c.args[0], Name(("value",))) for c in wanted) or any(calls(i.expr, WINDOWS) for i in s.items):
            return None
        step, bounds = int(constant(found[0].args[0])), time_bounds(s.where)
        if not _only_bounds(s.where):
            return None
        for size in sorted(self.tables, reverse=True):
            if step % size == 0 and _at_edges(s.where, size):
                self.used = size
                return self._over(planner, s, size, wanted, bounds)
        return None

    def _over(self, planner: Planner, s: Select, size: int, wanted: list[Call], bounds: Bounds) -> DataFrame:
        df = self.tables[size]
        df = df.where(F.col("series") == s.selector.name) if s.selector.name is not None else df.where(F.col("series_id") == s.selector.series_id)
        scope = Scope(names={"time": F.col("bucket")})
        df = df.where(scope.column(s.where)) if s.where is not None else df
        made = df.groupBy(time_bucket(F.lit(int(constant(buckets(s)[0].args[0]))), F.col("bucket")).alias("_key0"))
        made = made.agg(*[MERGED[c.name.lower() if c.args else "rows"]().alias(f"_agg{n}") for n, c in enumerate(wanted)], F.sum("points").alias("_rows"))
        df, scope = planner.grouped(s, made, [(c, f"_agg{n}") for n, c in enumerate(wanted)])
        return _project(planner, s, df, scope)


def _project(planner: Planner, s: Select, df: DataFrame, scope: Scope) -> DataFrame:
    class Ready(Planner):
        def aggregate(self, s: Select, points: DataFrame, inner: Scope) -> tuple[DataFrame, Scope]:
            return points, scope

    return Ready(planner.spark, planner.source).finish(s, df, scope, True)


def _only_bounds(where: Expr | None) -> bool:
    match where:
        case None:
            return True
        case Binary("and", left, right):
            return _only_bounds(left) and _only_bounds(right)
        case Binary(op, left, right):
            return op in ("<", ">=") and time_bounds(where) != Bounds() and isinstance(left, Name)
        case Between() | Call() | Literal() | Name() | Unary():
            return False
    return False


def _at_edges(where: Expr | None, size: int) -> bool:
    match where:
        case Binary("and", left, right):
            return _at_edges(left, size) and _at_edges(right, size)
        case Binary(_, _, right):
            b = time_bounds(where)
            edge = b.low if b.low is not None else b.high
            return edge is not None and edge % size == 0 and isinstance(right, Literal | Unary)
    return True
