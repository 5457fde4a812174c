"""Checks of a statement before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.registry import AGGREGATES, FUNCTIONS, WINDOWS, ArgumentError, result_type
from .language import Between, Binary, Call, Delete, Explain, Expr, Insert, Literal, Name, Select, Statement, Unary, walk


@dataclass(frozen=True)
class Diagnostic:
    """code: time_range_required, unsupported_fill_policy, invalid_function_arity, invalid_syntax or unimplemented."""

    code: str
    message: str


class CheckError(ValueError):
    def __init__(self, found: list[Diagnostic]):
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in found))
        self.diagnostics = found


def names_time(expr: Expr | None) -> bool:
    return any(isinstance(e, Name) and e.parts[-1].lower() == "time" for e in walk(expr))


def calls(expr: Expr | None, among: frozenset[str]) -> list[Call]:
    return [e for e in walk(expr) if isinstance(e, Call) and e.name.lower() in among]


def buckets(select: Select) -> list[Call]:
    return [e for g in select.group for e in [g] if isinstance(e, Call) and e.name.lower() == "time_bucket"]


def type_of(expr: Expr) -> str:
    """The static type; raises ArgumentError where a call's or operator's operands cannot have theirs."""
    match expr:
        case Literal(value):
            return "null" if value is None else {bool: "boolean", int: "integer", float: "float", str: "string"}[type(value)]
        case Name(parts):
            if parts[0].lower() == "tag":
                return "string"
            return {"time": "timestamp", "value": "value"}.get(parts[-1].lower(), "any")
        case Unary(op, operand):
            have = type_of(operand)
            if op == "not":
                if have not in ("boolean", "any", "null"):
                    raise ArgumentError(f"not takes a boolean, not {have}")
                return "boolean"
            if have in ("string", "boolean"):
                raise ArgumentError(f"unary {op} takes a number, not {have}")
            return "float"
        case Between(operand, low, high):
            for e in (operand, low, high):
                type_of(e)
            return "boolean"
        case Binary(op, left, right):
            a, b = type_of(left), type_of(right)
            if op in ("and", "or"):
                if {a, b} - {"boolean", "any", "null"}:
                    raise ArgumentError(f"{op} takes booleans, not {a} and {b}")
                return "boolean"
            if op in ("=", "!=", "=~", "!~"):
                return "boolean"
            timed = "timestamp" in (a, b)
            if {a, b} & {"boolean"} or "string" in (a, b) and not timed:
                raise ArgumentError(f"{op} takes numbers, not {a} and {b}")
            if op in ("<", "<=", ">", ">="):
                return "boolean"
            if op == "%" and {a, b} & {"float"}:
                raise ArgumentError("% takes integers")
            return "integer" if op == "%" else "float"
        case Call(name, args):
            if name.lower() not in FUNCTIONS:
                return "any"
            return result_type(name.lower(), [type_of(a) for a in args])
    return "any"


def check(statement: Statement, strict_types: bool = True) -> list[Diagnostic]:
    found: list[Diagnostic] = []

    def visit(expr: Expr | None) -> None:
        if expr is None:
            return
        unknown = [e for e in walk(expr) if isinstance(e, Call) and e.name.lower() not in FUNCTIONS]
        found.extend(Diagnostic("invalid_syntax", f"unknown function {e.name}") for e in unknown)
        if strict_types and not unknown:
            try:
                type_of(expr)
            except ArgumentError as e:
                found.append(Diagnostic("invalid_function_arity", str(e)))

    match statement:
        case Explain(target):
            return check(target, strict_types)
        case Insert():
            for v in statement.values:
                visit(v)
        case Delete():
            visit(statement.where)
            if not names_time(statement.where):
                found.append(Diagnostic("time_range_required", "delete requires a time predicate"))
        case Select():
            if statement.selector is not None and not names_time(statement.where):
                found.append(Diagnostic("time_range_required", "select requires a time predicate"))
            for e in (statement.where, *(i.expr for i in statement.items), *statement.group, *(o.expr for o in statement.order)):
                visit(e)
            if calls(statement.where, AGGREGATES | WINDOWS):
                found.append(Diagnostic("invalid_syntax", "where takes no aggregate or window function"))
            if statement.fill is not None:
                visit(statement.fill.value)
                if not buckets(statement):
                    found.append(Diagnostic("unsupported_fill_policy", "fill needs time_bucket in group by"))
    return found


def checked(statement: Statement) -> Statement:
    if found := check(statement):
        raise CheckError(found)
    return statement
