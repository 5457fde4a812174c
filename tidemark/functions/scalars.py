"""Scalar functions and operators of the language as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE, LONG = "double", "bigint"


def number(c: Column) -> Column:
    return c.cast(DOUBLE)


def time_bucket(step: Column, at: Column, origin: Column | None = None) -> Column:
    """The start of the bucket that holds `at`, floored also below zero; whole seconds."""
    step, at = step.cast(LONG), at.cast(LONG)
    shifted = at if origin is None else at - origin.cast(LONG)
    low = shifted - F.pmod(shifted, step)
    return low if origin is None else low + origin.cast(LONG)


def floored_remainder(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor, over integers; a zero divisor raises."""
    a, b = a.cast(LONG), b.cast(LONG)
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def ln(x: Column) -> Column:
    """As IEEE has it: minus infinity at zero, NaN below; Spark's own gives null there."""
    x = number(x)
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x <= 0, F.lit(float("nan")))


SCALARS = {
    "abs": lambda x: F.abs(number(x)),
    "ceil": lambda x: F.ceil(number(x)).cast(DOUBLE),
    "floor": lambda x: F.floor(number(x)).cast(DOUBLE),
    "round": lambda x: F.round(number(x)),
    "pow": lambda x, y: F.pow(number(x), number(y)),
    "ln": ln,
    "sqrt": lambda x: F.sqrt(number(x)),
    "now": lambda: F.unix_seconds(F.current_timestamp()),
    "time_bucket": time_bucket,
    "coalesce": lambda *xs: F.coalesce(*xs),
}


def binary(op: str, a: Column, b: Column) -> Column:
    match op:
        case "and":
            return a & b
        case "or":
            return a | b
        case "=":
            return a.eqNullSafe(b)
        case "!=":
            return ~a.eqNullSafe(b)
        case "=~":
            return F.rlike(a, b)
        case "!~":
            return ~F.rlike(a, b)
        case "<":
            return a < b
        case "<=":
            return a <= b
        case ">":
            return a > b
        case ">=":
            return a >= b
        case "+":
            return number(a) + number(b)
        case "-":
            return number(a) - number(b)
        case "*":
            return number(a) * number(b)
        case "/":
            return number(a) / number(b)
        case "%":
            return floored_remainder(a, b)
    raise ValueError(op)
