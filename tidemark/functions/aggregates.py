"""Aggregates of the language, the rate family among them, as Spark columns.

The rate family reads the point before within one series and group. `before` names the columns that hold its time and value;
one window over (series, group keys) ordered by (time, seq) makes them for all calls over the same argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import DOUBLE, number


def order() -> Column:
    return F.struct("time", "seq")


def _elapsed() -> Column:
    return (F.max("time") - F.min("time")).cast(DOUBLE)


def first(x: Column) -> Column:
    return F.min_by(x, order())


def last(x: Column) -> Column:
    return F.max_by(x, order())


def delta(x: Column) -> Column:
    """Last minus first; null for fewer than two points."""
    return F.when(F.count(F.lit(1)) >= 2, last(number(x)) - first(number(x)))


def rate(x: Column, before: Column) -> Column:
    """Increase a second; a fall is a counter's reset, from which the new value counts. Null if no time passed."""
    x, was = number(x), before["value"]
    grown = F.when(was.isNotNull(), F.when(x >= was, x - was).otherwise(x))
    return F.when(_elapsed() > 0, F.sum(grown) / F.nullif(_elapsed(), F.lit(0.0)))


def irate(x: Column, before: Column) -> Column:
    """The slope between the last two points; null if no time passed between them."""
    pair = F.max_by(F.struct((number(x) - before["value"]).alias("dv"), (F.col("time") - before["time"]).cast(DOUBLE).alias("dt")), order())
    return F.when(pair["dt"] > 0, pair["dv"] / F.nullif(pair["dt"], F.lit(0.0)))


def integral(x: Column, before: Column) -> Column:
    """Trapezoids between neighbours."""
    return F.sum((number(x) + before["value"]) / 2 * (F.col("time") - before["time"]))


PLAIN = {
    "avg": lambda x: F.avg(number(x)),
    "sum": lambda x: F.sum(number(x)),
    "min": F.min,
    "max": F.max,
    "count": lambda x=None: F.count(F.lit(1) if x is None else x),
    "first": first,
    "last": last,
    "percentile": lambda x, p: F.percentile(number(x), p),
    "delta": delta,
}
PAIRED = {"rate": rate, "irate": irate, "integral": integral}
