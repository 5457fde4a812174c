"""The functions of the language: kinds, arguments and result types."""

from __future__ import annotations

from dataclasses import dataclass

#: Types a numeric argument takes.
NUMERIC = frozenset(("integer", "float", "numeric", "value", "any", "null"))
#: Static type to PostgreSQL type id; fixed values.
OIDS = {"boolean": 16, "integer": 20, "float": 701, "numeric": 1700, "value": 25, "string": 25, "timestamp": 1114, "duration": 1186, "tags": 3802, "null": 25, "any": 25}


@dataclass(frozen=True)
class Arg:
    kind: str  # numeric, any, duration, timestamp, integer or float
    optional: bool = False
    variadic: bool = False


@dataclass(frozen=True)
class Function:
    name: str
    kind: str  # aggregate, scalar, window or fill
    args: tuple[Arg, ...]
    result: str  # a type, or "same" as the first argument
    nullable: bool = True
    ordered: bool = False  # needs points in time order
    by_bucket: bool = False  # differs by bucket


def _one(name: str, kind: str, result: str, *args: str, **more) -> Function:
    return Function(name, kind, tuple(Arg(a.rstrip("?*"), "?" in a, "*" in a) for a in args), result, **more)


FUNCTIONS = {
    f.name: f
    for f in (
        _one("avg", "aggregate", "float", "numeric"),
        _one("sum", "aggregate", "same", "numeric"),
        _one("min", "aggregate", "same", "numeric"),
        _one("max", "aggregate", "same", "numeric"),
        _one("count", "aggregate", "integer", "any?", nullable=False),
        _one("first", "aggregate", "same", "numeric", ordered=True),
        _one("last", "aggregate", "same", "numeric", ordered=True),
        _one("percentile", "aggregate", "float", "numeric", "float"),
        _one("rate", "aggregate", "float", "numeric", ordered=True, by_bucket=True),
        _one("irate", "aggregate", "float", "numeric", ordered=True, by_bucket=True),
        _one("delta", "aggregate", "float", "numeric", ordered=True, by_bucket=True),
        _one("integral", "aggregate", "float", "numeric", ordered=True, by_bucket=True),
        _one("abs", "scalar", "float", "numeric"),
        _one("ceil", "scalar", "float", "numeric"),
        _one("floor", "scalar", "float", "numeric"),
        _one("round", "scalar", "float", "numeric"),
        _one("pow", "scalar", "float", "numeric", "numeric"),
        _one("ln", "scalar", "float", "numeric"),
        _one("sqrt", "scalar", "float", "numeric"),
        _one("now", "scalar", "timestamp", nullable=False),
        _one("time_bucket", "scalar", "timestamp", "duration", "timestamp", "timestamp?", by_bucket=True),
        _one("lag", "window", "same", "any", "integer?", ordered=True),
        _one("lead", "window", "same", "any", "integer?", ordered=True),
        _one("moving_avg", "window", "float", "numeric", "duration", ordered=True),
        _one("ema", "window", "float", "numeric", "duration", "float", ordered=True),
        _one("coalesce", "fill", "same", "any*", nullable=False),
        _one("fill_forward", "fill", "same", "numeric", ordered=True),
    )
}
AGGREGATES = frozenset(n for n, f in FUNCTIONS.items() if f.kind == "aggregate")
PAIRED = frozenset(("rate", "irate", "integral"))  # need the point before
WINDOWS = frozenset(n for n, f in FUNCTIONS.items() if f.kind == "window") | {"fill_forward"}


class ArgumentError(ValueError):
    pass


def _fits(want: str, have: str) -> bool:
    if have in ("any", "null") or want == "any":
        return True
    if want == "numeric":
        return have in NUMERIC
    if want in ("duration", "timestamp"):
        return have in NUMERIC or have == want or want == "timestamp" and have == "string"
    return have == want


def result_type(name: str, types: list[str]) -> str:
    """The type a call gives; raises for a wrong number or type of arguments."""
    f = FUNCTIONS[name]
    least = sum(not a.optional for a in f.args)
    most = None if any(a.variadic for a in f.args) else len(f.args)
    if len(types) < least or most is not None and len(types) > most:
        raise ArgumentError(f"{name} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(types)}")
    for i, have in enumerate(types):
        want = f.args[min(i, len(f.args) - 1)]
        if not _fits(want.kind, have):
            raise ArgumentError(f"argument {i + 1} of {name} must be {want.kind}, not {have}")
    return f.result if f.result != "same" else types[0]
