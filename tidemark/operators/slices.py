"""Windows over long series, cut into slices of time: no task sorts a whole series.

A slice is a task's share. What a row needs from outside its slice comes to it: the rows at the slices' edges for neighbours, the
rows of the span before the slice for moving averages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 86_400


@dataclass(frozen=True)
class Neighbour:
    """The value of `value` at `n` rows before (or, if `ahead`, after) each row, as column `out`."""

    value: Column
    out: str
    n: int = 1
    ahead: bool = False


def slot(at: str, size: int) -> Column:
    return F.floor(F.col(at) / size)


def neighbours(df: DataFrame, wanted: list[Neighbour], by: list[str], order: list[str], size: int = SLICE) -> DataFrame:
    """df with a column for each of `wanted`, over rows with equal `by` in the order of `order`, whose first is a time.

    Rows n or further from a slice's edge find their neighbours in it. For the others, the first and last n rows of all slices, in
    order, are enough: between a row at an edge and its neighbour no row is missing. One task sees 2 n rows a slice of a series.
    """
    far = max(w.n for w in wanted)
    inside, edges = Window.partitionBy(*by, "_slot").orderBy(*order), Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by, "_slot")
    df = df.withColumn("_slot", slot(order[0], size)).withColumns({f"_in_{w.out}": w.value for w in wanted})

    def found(w: Neighbour, over: Window) -> Column:
        return (F.lead if w.ahead else F.lag)(f"_in_{w.out}", w.n).over(over)

    df = df.withColumns({"_pos": F.row_number().over(inside), "_all": F.count(F.lit(1)).over(whole)} | {w.out: found(w, inside) for w in wanted})
    back = F.col("_all") - F.col("_pos") + 1
    edge = (F.col("_pos") <= far) | (back <= far)
    outer = df.where(edge).withColumns({f"_out_{w.out}": found(w, edges) for w in wanted})
    outer = outer.withColumns({w.out: F.when((back if w.ahead else F.col("_pos")) <= w.n, F.col(f"_out_{w.out}")).otherwise(F.col(w.out)) for w in wanted}).drop(*[f"_out_{w.out}" for w in wanted])
    return df.where(~edge).unionByName(outer).drop("_slot", "_pos", "_all", *[f"_in_{w.out}" for w in wanted])


def moving_average(df: DataFrame, value: Column, span: int, out: str, by: list[str], at: str, size: int = SLICE) -> DataFrame:
    """df with the average of `value` over (t - span, t]; rows of the span before a slice go to it, too."""
    size = max(size, span)
    own = df.withColumn("_own", slot(at, size)).withColumn("_value", value)
    near = F.col(at) > (F.col("_own") + 1) * size - span
    both = own.withColumn("_slot", F.explode(F.when(near, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    over = Window.partitionBy(*by, "_slot").orderBy(at).rangeBetween(-(span - 1), 0)
    return both.withColumn(out, F.avg("_value").over(over)).where("_own = _slot").drop("_own", "_slot", "_value")
