"""From a checked statement to a DataFrame: one place that knows both."""

from __future__ import annotations

import time as clock
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates, scalars
from ..functions.registry import AGGREGATES, PAIRED, WINDOWS
from ..operators import ema as ema_operator
from ..operators import fill as fill_operator
from ..operators import slices
from ..sources.points import Bounds, PointSource
from ..sources.series import signed
from .checks import buckets, calls, type_of
from .language import Between, Binary, Call, Expr, Item, Literal, Name, Select, Unary, instant


class PlanError(ValueError):
    pass


def constant(expr: Expr) -> int | float | str | bool | None:
    """The value of an expression of literals; raises if it is none."""
    match expr:
        case Literal(value):
            return value
        case Unary("-", operand):
            return -constant(operand)
        case Unary("+", operand):
            return constant(operand)
        case Binary(op, left, right) if op in "+-*":
            a, b = constant(left), constant(right)
            if not (isinstance(a, int | float) and isinstance(b, int | float)):
                raise PlanError("numbers are needed")
            return a + b if op == "+" else a - b if op == "-" else a * b
    raise PlanError("a constant is needed")


def _seconds(expr: Expr, low: bool = False) -> int | float | None:
    """A constant time; None for anything else. The clock when the plan is made is a lower bound of now(), never an upper one."""
    try:
        value = constant(_clocked(expr) if low else expr)
    except PlanError:
        return None
    if isinstance(value, str):
        return instant(value)
    return value if isinstance(value, int | float) and not isinstance(value, bool) else None


def _clocked(expr: Expr) -> Expr:
    """now() as the time of planning, where a later now() only raises the value."""
    match expr:
        case Call(name, ()) if name.lower() == "now":
            return Literal(int(clock.time()))
        case Binary(op, left, right) if op in "+-":
            return Binary(op, _clocked(left), _clocked(right) if op == "+" else right)
    return expr


def _is_time(expr: Expr) -> bool:
    return isinstance(expr, Name) and expr.parts[-1].lower() == "time" and expr.parts[0].lower() != "tag"


def time_bounds(where: Expr | None) -> Bounds:
    """Inclusive bounds that the ANDed comparisons of time with constants imply; the predicate itself still applies."""
    match where:
        case Binary("and", left, right):
            a, b = time_bounds(left), time_bounds(right)
            lows, highs = [x for x in (a.low, b.low) if x is not None], [x for x in (a.high, b.high) if x is not None]
            return Bounds(max(lows, default=None), min(highs, default=None))
        case Between(operand, low, high) if _is_time(operand):
            a, b = _seconds(low, low=True), _seconds(high)
            return Bounds(None if a is None else int(a // 1), None if b is None else int(b // 1))
        case Binary(op, left, right) if op in ("<", "<=", ">", ">=", "="):
            if _is_time(right):
                left, right, op = right, left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            value = _seconds(right, low=op in (">", ">=")) if _is_time(left) else None
            if value is None:
                return Bounds()
            edge = int(value // 1)
            return Bounds(edge if op in (">", ">=", "=") else None, edge if op in ("<", "<=", "=") else None)
    return Bounds()


def column_name(item: Item, index: int) -> str:
    if item.alias:
        return item.alias
    if isinstance(item.expr, Name):
        return item.expr.text
    if isinstance(item.expr, Call):
        return f"{item.expr.name}_{index}"
    return f"_col{index}"


def _same(a: Expr, b: Expr) -> bool:
    return _folded(a) == _folded(b)


def _folded(e: Expr) -> Expr:
    match e:
        case Name(parts):
            return Name(tuple(p.lower() for p in parts))
        case Unary(op, operand):
            return Unary(op, _folded(operand))
        case Binary(op, left, right):
            return Binary(op, _folded(left), _folded(right))
        case Between(a, b, c):
            return Between(_folded(a), _folded(b), _folded(c))
        case Call(name, args):
            return Call(name.lower(), tuple(map(_folded, args)))
    return e


@dataclass
class Scope:
    """How the names and calls of an expression become columns; `known` holds columns that stand for whole expressions."""

    known: list[tuple[Expr, Column]] = field(default_factory=list)
    names: dict[str, Column] = field(default_factory=dict)
    over: Window | None = None
    order: str = "time"
    before: dict = field(default_factory=dict)

    def column(self, expr: Expr) -> Column:
        for e, c in self.known:
            if _same(e, expr):
                return c
        match expr:
            case Literal(value):
                return F.lit(value)
            case Name(parts):
                return self.name(parts)
            case Unary("not", operand):
                return ~self.column(operand)
            case Unary("-", operand):
                return -scalars.number(self.column(operand))
            case Unary("+", operand):
                return scalars.number(self.column(operand))
            case Between(operand, low, high):
                a, b, c = (self.timed(e, operand) for e in (operand, low, high))
                return a.between(b, c)
            case Binary(op, left, right):
                return scalars.binary(op, self.timed(left, right), self.timed(right, left))
            case Call(name, args):
                return self.call(name.lower(), args)
        raise PlanError(f"cannot plan {expr}")

    def timed(self, expr: Expr, other: Expr) -> Column:
        """A text that is compared with a time is an ISO instant."""
        if isinstance(expr, Literal) and isinstance(expr.value, str) and type_of(other) == "timestamp":
            if (at := instant(expr.value)) is None:
                raise PlanError(f"{expr.value!r} is no timestamp")
            return F.lit(at)
        return self.column(expr)

    def name(self, parts: tuple[str, ...]) -> Column:
        whole = ".".join(parts).lower()
        for key in (whole, parts[-1].lower()):
            if key in self.names and (parts[0].lower() != "tag" or key == whole):
                return self.names[key]
        if parts[0].lower() == "tag" and len(parts) > 1 and "tags" in self.names:
            return F.try_element_at(self.names["tags"], F.lit(".".join(parts[1:])))
        raise PlanError(f"unknown column {'.'.join(parts)}")

    def call(self, name: str, args: tuple[Expr, ...]) -> Column:
        if name in scalars.SCALARS:
            return scalars.SCALARS[name](*map(self.column, args))
        if name in WINDOWS:
            return self.window(name, args)
        if name in aggregates.PLAIN:
            if name == "percentile":
                share = constant(args[1])
                if not 0 <= share <= 1:
                    raise PlanError("percentile takes a share from 0 to 1")
                return F.percentile(scalars.number(self.column(args[0])), share)
            return aggregates.PLAIN[name](*map(self.column, args))
        if name in aggregates.PAIRED:
            return aggregates.PAIRED[name](self.column(args[0]), next(c for e, c in self.before.items() if _same(e, args[0])))
        raise PlanError(f"unknown function {name}")

    def window(self, name: str, args: tuple[Expr, ...]) -> Column:
        if self.over is None:
            raise PlanError(f"{name} is not possible here")
        x = self.column(args[0])
        if name == "fill_forward":
            return F.last(x, ignorenulls=True).over(self.over.rowsBetween(Window.unboundedPreceding, 0))
        raise PlanError(f"{name} is not possible here")


class Planner:
    """Plans selects over a source of points; `rollups` are pre-aggregated tables that may stand in (see rollup.py)."""

    def __init__(self, spark: SparkSession, source: PointSource, rollups=None):
        self.spark, self.source, self.rollups = spark, source, rollups

    def select(self, s: Select) -> DataFrame:
        if s.star:
            if s.selector is None:
                raise PlanError("* needs a series")
            s = replace(s, star=False, items=(Item(Name(("time",))), Item(Name(("value",))), *s.items))
        grouped = bool(s.group) or any(calls(i.expr, AGGREGATES) for i in s.items)
        if grouped and self.rollups is not None and s.selector is not None:
            if (made := self.rollups.plan(self, s)) is not None:
                return made
        if s.selector is None:
            points = self.spark.range(1).drop("id")
            scope = Scope()
        else:
            points = self.points(s)
            scope = Scope(names={c: F.col(c) for c in ("series_id", "series", "tags", "time", "value")})
        if s.where is not None:
            points = points.where(scope.column(s.where))
        return self.finish(s, points, scope, grouped)

    def points(self, s: Select) -> DataFrame:
        sel, bounds = s.selector, time_bounds(s.where)
        number = None if sel.series_id is None else signed(sel.series_id)
        df = self.source.scan(bounds, sel.name, number)
        return df.where(F.col("series") == sel.name) if sel.name is not None else df.where(F.col("series_id") == number)

    def finish(self, s: Select, points: DataFrame, scope: Scope, grouped: bool) -> DataFrame:
        if grouped:
            df, scope = self.aggregate(s, points, scope)
        else:
            by = Window.partitionBy("series_id")
            df, scope = points, replace(scope, over=by.orderBy("time", "seq")) if s.selector is not None else scope
        df, scope = self.averages(s, df, scope, grouped)
        out = [(column_name(i, n), i.expr) for n, i in enumerate(s.items)]
        # a tie of names gets its position, so that no column hides another
        seen: set[str] = set()
        named = []
        for n, (name, expr) in enumerate(out):
            name = name if name.lower() not in seen else f"{name}_{n}"
            seen.add(name.lower())
            named.append((name, expr))
        df = df.withColumns({f"_out{n}": scope.column(e) for n, (_, e) in enumerate(named)})
        if s.order:
            inner = Scope(known=[*[(e, F.col(f"_out{n}")) for n, (_, e) in enumerate(named)], *scope.known], names={**scope.names, **{k.lower(): F.col(f"_out{n}") for n, (k, _) in enumerate(named)}}, over=scope.over)
            df = df.orderBy(*[inner.column(o.expr).desc_nulls_last() if o.descending else inner.column(o.expr).asc_nulls_first() for o in s.order])
        df = df.select(*[F.col(f"_out{n}").alias(k) for n, (k, _) in enumerate(named)])
        if s.offset:
            df = df.offset(s.offset)
        return df if s.limit is None else df.limit(s.limit)

    def averages(self, s: Select, df: DataFrame, scope: Scope, grouped: bool) -> tuple[DataFrame, Scope]:
        """Windows over long series become columns before the projection, slice by slice (see operators.slices and operators.ema)."""
        wanted = list({_folded(c): c for e in (*[i.expr for i in s.items], *[o.expr for o in s.order]) for c in calls(e, frozenset(("ema", "lag", "lead", "moving_avg")))}.values())
        known = list(scope.known)
        if not wanted:
            return df, scope
        if grouped:
            by, order = [k for k in df.columns if k.startswith("_key") and k != scope.order], [scope.order]
            size = int(constant(buckets(s)[0].args[0])) * slices.SLICE if buckets(s) else slices.SLICE
        else:
            by, order, size = ["series_id"], ["time", "seq"], slices.SLICE
        near = []
        for n, c in enumerate(wanted):
            if scope.over is None:
                raise PlanError(f"{c.name.lower()} is not possible here")
            x = scope.column(c.args[0])
            match c.name.lower():
                case "ema":
                    step, alpha = constant(c.args[1]), float(constant(c.args[2]))
                    if not grouped and step != 0:
                        raise PlanError("ema with a step needs group by time_bucket of that step; step 0 takes raw points")
                    df = ema_operator.ema(df.withColumn(f"_ema_in{n}", scalars.number(x)), f"_ema_in{n}", alpha, by, order, f"_win{n}", size=size)
                case "moving_avg":
                    df = slices.moving_average(df, scalars.number(x), int(constant(c.args[1])), f"_win{n}", by, order[0], size)
                case name:
                    far = int(constant(c.args[1])) if len(c.args) > 1 else 1
                    if far < 0:
                        name, far = "lead" if name == "lag" else "lag", -far
                    near.append(slices.Neighbour(x, f"_win{n}", far, name == "lead"))
            known.append((c, F.col(f"_win{n}")))
        if near:
            df = slices.neighbours(df, near, by, order, size)
        return df, replace(scope, known=known)

    def aggregate(self, s: Select, points: DataFrame, scope: Scope) -> tuple[DataFrame, Scope]:
        keys = {f"_key{n}": scope.column(g) for n, g in enumerate(s.group)}
        df = points.withColumns(keys) if keys else points
        wanted = [c for e in (*[i.expr for i in s.items], *[o.expr for o in s.order]) for c in calls(e, AGGREGATES)]
        paired = {_folded(c.args[0]): c.args[0] for c in wanted if c.name.lower() in PAIRED}
        if paired:
            found = [slices.Neighbour(scalars.number(scope.column(e)), f"_was{n}") for n, e in enumerate(paired.values())] + [slices.Neighbour(F.col("time"), "_was_time")]
            df = slices.neighbours(df, found, ["series_id", *keys], ["time", "seq"])
            scope = replace(scope, before={e: {"value": F.col(f"_was{n}"), "time": F.col("_was_time")} for n, e in enumerate(paired.values())})
        distinct = list({_folded(c): c for c in wanted}.values())
        found = [scope.column(c).alias(f"_agg{n}") for n, c in enumerate(distinct)]
        made = df.groupBy(*keys).agg(*found, F.count(F.lit(1)).alias("_rows"))
        if not keys:
            made = made.where("_rows > 0")  # nothing in, nothing out
        return self.grouped(s, made, [(c, f"_agg{n}") for n, c in enumerate(distinct)])

    def grouped(self, s: Select, made: DataFrame, found: list[tuple[Call, str]]) -> tuple[DataFrame, Scope]:
        """Gap filling, and the scope in which group keys and aggregates are columns."""
        bucket = next((f"_key{n}" for n, g in enumerate(s.group) if g in buckets(s)), None)
        others = [f"_key{n}" for n in range(len(s.group)) if f"_key{n}" != bucket]
        if s.fill is not None:
            step = int(constant(buckets(s)[0].args[0]))
            value = None if s.fill.value is None else Scope().column(s.fill.value)
            made = fill_operator.fill(made, bucket, step, others, [a for _, a in found], s.fill.kind, value)
        known = [(g, F.col(f"_key{n}")) for n, g in enumerate(s.group)] + [(c, F.col(a)) for c, a in found]
        scope = Scope(known=known, order=bucket or "_rows")
        if bucket:
            by = Window.partitionBy(*others)
            scope = replace(scope, over=by.orderBy(bucket))
        return made, scope


def explain(df: DataFrame) -> str:
    """The formatted plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

