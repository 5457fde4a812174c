"""The query language: lexer, syntax tree and parser. No Spark here.

Binding strength, weakest first: OR, AND, equality and matching, comparison, sum, product, unary minus and NOT, call.
NOT binds tighter than comparison: `not value > 5` reads as `(not value) > 5`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

KEYWORDS = frozenset("select from where group by fill order limit offset insert into values delete explain as tag time now between and or not previous linear asc desc true false null".split())
#: Seconds in a unit of a duration such as 5m.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_LEX = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<instant>\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)
      | (?P<duration>(?:\d+[smhdw])+\b)
      | (?P<float>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
      | (?P<int>\d+)
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*")
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<op>=~|!~|!=|<=|>=|&&|\|\||[=<>+\-*/%(),.;])""",
    re.X | re.S,
)


_REGEX = re.compile(r"/((?:[^/\\\n]|\\.)*)/")
_PART = re.compile(r"(\d+)([smhdw])")


class LanguageError(ValueError):
    """A text that does not lex or parse; `code` is that of the diagnostic."""

    def __init__(self, message: str, position: int, code: str = "invalid_syntax"):
        super().__init__(f"{message} at {position}")
        self.code, self.position = code, position


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def keyword(self) -> str | None:
        return self.text.lower() if self.kind == "word" and self.text.lower() in KEYWORDS else None


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Name:
    """A path; quoted parts are kept without their quotes."""

    parts: tuple[str, ...]

    @property
    def text(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Between:
    operand: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


Expr = Literal | Name | Unary | Binary | Between | Call


@dataclass(frozen=True)
class Selector:
    """A series by name or by id."""

    name: str | None = None
    series_id: int | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Fill:
    """previous, linear, null, or constant with an expression."""

    kind: str
    value: Expr | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    selector: Selector | None = None
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    fill: Fill | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    star: bool = False


@dataclass(frozen=True)
class Insert:
    series: str
    columns: tuple[str, ...]
    values: tuple[Expr, ...]


@dataclass(frozen=True)
class Delete:
    series: str
    where: Expr | None = None


@dataclass(frozen=True)
class Explain:
    target: Statement


Statement = Select | Insert | Delete | Explain


def tokens(text: str, lenient: bool = False) -> list[Token]:
    """The tokens of a text; if lenient, characters of other languages are operators by themselves."""
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if text[at] == "/" and out and out[-1].text in ("=~", "!~") and (r := _REGEX.match(text, at)):
            out.append(Token("regex", r[0], at, r.end()))
            at = r.end()
            continue
        if m is None and lenient and text[at] not in "'\"":
            out.append(Token("op", text[at], at, at + 1))
            at += 1
            continue
        if m is None:
            raise LanguageError("unterminated text" if text[at] in "'\"" else f"unexpected character {text[at]!r}", at)
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


#: Left binding strength of the binary operators.
_STRENGTH = {"or": 1, "||": 1, "and": 2, "&&": 2} | dict.fromkeys(("=", "!=", "=~", "!~"), 3) | dict.fromkeys(("<", "<=", ">", ">=", "between"), 4) | dict.fromkeys("+-", 5) | dict.fromkeys("*/%", 6)
_SPELLED = {"||": "or", "&&": "and"}


def _instant(text: str) -> int:
    if (found := instant(text)) is None:
        raise LanguageError(f"{text} is no timestamp", 0)
    return found


#: Values of literal tokens by kind.
_VALUES = {
    "int": int,
    "float": float,
    "string": lambda s: s[1:-1].replace("''", "'"),
    "regex": lambda s: s[1:-1].replace("\\/", "/"),
    "duration": lambda s: sum(int(n) * UNITS[u] for n, u in _PART.findall(s)),
    "instant": _instant,
}


@dataclass
class Parser:
    text: str
    held: list[Token] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        self.held = tokens(self.text)

    # -- tokens
    @property
    def now(self) -> Token:
        return self.held[self.at] if self.at < len(self.held) else Token("end", "", len(self.text), len(self.text))

    def fail(self, wanted: str) -> LanguageError:
        return LanguageError(f"expected {wanted}, found {self.now.text or 'the end'!r}", self.now.start)

    def take(self) -> Token:
        t = self.now
        self.at += 1
        return t

    def is_(self, *what: str) -> bool:
        t = self.now
        return (t.keyword in what) or (t.kind == "op" and t.text in what)

    def accept(self, *what: str) -> bool:
        if self.is_(*what):
            self.at += 1
            return True
        return False

    def expect(self, what: str) -> None:
        if not self.accept(what):
            raise self.fail(what)

    def integer(self, what: str) -> int:
        if self.now.kind != "int":
            raise self.fail(what)
        return int(self.take().text)

    # -- statements
    def statement(self) -> Statement:
        made = self._statement()
        self.accept(";")
        if self.now.kind != "end":
            raise self.fail("the end")
        return made

    def _statement(self) -> Statement:
        if self.accept("explain"):
            return Explain(self._statement())
        if self.accept("select"):
            return self._select()
        if self.accept("insert"):
            return self._insert()
        if self.accept("delete"):
            self.expect("from")
            return Delete(self._path(), self.expression() if self.accept("where") else None)
        raise self.fail("a statement")

    def _select(self) -> Select:
        star = self.accept("*")
        items = [] if star else [self._item()]
        while self.accept(","):
            items.append(self._item())
        found: dict = {}
        if self.accept("from"):
            found["selector"] = self._selector()
        if self.accept("where"):
            found["where"] = self.expression()
        if self.accept("group"):
            self.expect("by")
            group = [self.expression()]
            while self.accept(","):
                group.append(self.expression())
            found["group"] = tuple(group)
        if self.accept("fill"):
            found["fill"] = self._fill()
        if self.accept("order"):
            self.expect("by")
            order = [self._order()]
            while self.accept(","):
                order.append(self._order())
            found["order"] = tuple(order)
        if self.accept("limit"):
            found["limit"] = self.integer("a number of rows")
            if self.accept("offset"):
                found["offset"] = self.integer("a number of rows")
        return Select(tuple(items), star=star, **found)

    def _item(self) -> Item:
        expr = self.expression()
        if self.accept("as"):
            return Item(expr, self._word(keywords=("time", "tag")))
        if self.now.kind == "quoted" or self.now.kind == "word" and self.now.keyword is None:
            return Item(expr, self._word())
        return Item(expr)

    def _selector(self) -> Selector:
        if self.now.kind == "word" and self.now.text.lower() == "by_id" and self.at + 1 < len(self.held) and self.held[self.at + 1].text == "(":
            self.at += 2
            number = self.integer("a series id")
            self.expect(")")
            return Selector(series_id=number)
        if self.now.kind == "string":
            return Selector(name=_VALUES["string"](self.take().text))
        return Selector(name=self._path())

    def _fill(self) -> Fill:
        self.expect("(")
        made = None
        for kind in ("previous", "linear", "null"):
            if self.accept(kind):
                made = Fill(kind)
        if made is None:
            made = Fill("constant", self.expression())
        self.expect(")")
        return made

    def _order(self) -> Order:
        expr = self.expression()
        down = self.accept("desc")
        if not down:
            self.accept("asc")
        return Order(expr, down)

    def _insert(self) -> Insert:
        self.expect("into")
        series, columns = self._path(), []
        if self.accept("("):
            columns.append(self._word(keywords=("time", "tag")))
            while self.accept(","):
                columns.append(self._word(keywords=("time", "tag")))
            self.expect(")")
        self.expect("values")
        self.expect("(")
        values = [self.expression()]
        while self.accept(","):
            values.append(self.expression())
        self.expect(")")
        if columns and len(columns) != len(values):
            raise LanguageError("as many values as columns are needed", self.now.start)
        return Insert(series, tuple(columns), tuple(values))

    # -- names
    def _word(self, keywords: tuple[str, ...] = ()) -> str:
        t = self.now
        if t.kind == "quoted":
            self.at += 1
            return t.text[1:-1].replace('""', '"')
        if t.kind == "word" and (t.keyword is None or t.keyword in keywords):
            self.at += 1
            return t.text
        raise self.fail("a name")

    def _path(self) -> str:
        parts = [self._word(keywords=("time", "tag"))]
        while self.accept("."):
            parts.append(self._word(keywords=tuple(KEYWORDS)))
        return ".".join(parts)

    # -- expressions
    def expression(self, least: int = 1) -> Expr:
        left = self._prefix()
        while True:
            op = self.now.keyword or (self.now.text if self.now.kind == "op" else None)
            strength = _STRENGTH.get(op or "", 0)
            if strength < least:
                return left
            self.at += 1
            if op == "between":
                low = self.expression(5)
                self.expect("and")
                left = Between(left, low, self.expression(5))
            else:
                left = Binary(_SPELLED.get(op, op), left, self.expression(strength + 1))

    def _prefix(self) -> Expr:
        if self.accept("-"):
            return Unary("-", self._prefix())
        if self.accept("+"):
            return Unary("+", self._prefix())
        if self.accept("not"):
            return Unary("not", self._prefix())
        if self.accept("("):
            inner = self.expression()
            self.expect(")")
            return inner
        t = self.now
        if t.kind in _VALUES:
            self.at += 1
            return Literal(_VALUES[t.kind](t.text))
        if t.keyword in ("true", "false", "null"):
            self.at += 1
            return Literal({"true": True, "false": False, "null": None}[t.keyword])
        if t.kind == "quoted" or t.kind == "word" and t.keyword in (None, "time", "tag", "now"):
            parts = [self._word(keywords=("time", "tag", "now"))]
            while self.accept("."):
                parts.append(self._word(keywords=tuple(KEYWORDS)))
            if self.accept("("):
                args = []
                if not self.accept(")"):
                    args.append(self.expression())
                    while self.accept(","):
                        args.append(self.expression())
                    self.expect(")")
                return Call(".".join(parts), tuple(args))
            return Name(tuple(parts))
        raise self.fail("an expression")


def parse(text: str) -> Statement:
    return Parser(text).statement()


def instant(value: str) -> int | None:
    """Epoch seconds of an ISO date or timestamp (UTC unless it says otherwise); None if the text is neither."""
    try:
        found = datetime.fromisoformat(value)
    except ValueError:
        return None
    return int((found if found.tzinfo else found.replace(tzinfo=timezone.utc)).timestamp())


def walk(expr: Expr | None):
    """The expression and all below it."""
    if expr is None:
        return
    yield expr
    for below in {Unary: lambda e: (e.operand,), Binary: lambda e: (e.left, e.right), Between: lambda e: (e.operand, e.low, e.high), Call: lambda e: e.args}.get(type(expr), lambda e: ())(expr):
        yield from walk(below)
