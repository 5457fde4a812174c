"""From PostgreSQL-style SQL text to the query language, by tokens."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import dataclass, field

from .language import LanguageError, Token, tokens

log = logging.getLogger("tidemark.translate")

#: SQLSTATE, severity and message by name; fixed values.
SQLSTATES = {
    "successful_completion": ("00000", "NOTICE", "successful completion"),
    "unique_violation": ("23505", "ERROR", "duplicate key value violates unique constraint"),
    "not_null_violation": ("23502", "ERROR", "null value violates not-null constraint"),
    "foreign_key_violation": ("23503", "ERROR", "insert or update on table violates foreign key constraint"),
    "check_violation": ("23514", "ERROR", "check constraint violation"),
    "serialization_failure": ("40001", "ERROR", "could not serialize access due to concurrent update"),
    "deadlock_detected": ("40P01", "ERROR", "deadlock detected"),
    "syntax_error": ("42601", "ERROR", "syntax error"),
    "undefined_table": ("42P01", "ERROR", "relation does not exist"),
    "undefined_column": ("42703", "ERROR", "column does not exist"),
    "insufficient_privilege": ("42501", "ERROR", "permission denied"),
    "duplicate_object": ("42710", "ERROR", "duplicate object"),
    "feature_not_supported": ("0A000", "ERROR", "feature not supported"),
    "invalid_parameter_value": ("22023", "ERROR", "invalid parameter value"),
}


@dataclass(frozen=True)
class Translation:
    """Either `text`, or `sqlstate` and `message`."""

    text: str | None = None
    sqlstate: str | None = None
    message: str | None = None

    @property
    def ok(self) -> bool:
        return self.text is not None


@dataclass
class Counters:
    translations: int = 0
    fallbacks: int = 0
    cache_hits: int = 0


@dataclass
class Translator:
    """Translates, counts, and logs one in `sample` translations as JSON."""

    sample: int = 0
    counters: Counters = field(default_factory=Counters)
    _known: dict[str, Translation] = field(default_factory=dict)

    def translate(self, sql: str) -> Translation:
        began = time.perf_counter_ns()
        made = self._known.get(sql)
        if made is not None:
            self.counters.cache_hits += 1
        else:
            made = translate(sql)
            if len(self._known) < 1000:
                self._known[sql] = made
        self.counters.translations += made.ok
        self.counters.fallbacks += not made.ok
        if self.sample and (self.counters.translations + self.counters.fallbacks) % self.sample == 0:
            log.info(json.dumps({"sql": sql, "text": made.text or "", "cache_hit": False, "fallback": not made.ok, "duration_ns": time.perf_counter_ns() - began}))
        return made


def _unsupported() -> Translation:
    code, _, message = SQLSTATES["feature_not_supported"]
    return Translation(sqlstate=code, message=message)


def translate(sql: str) -> Translation:
    """SELECT, INSERT and DELETE without RETURNING; all else is not supported."""
    text = sql.strip()
    try:
        found = tokens(text, lenient=True)
    except LanguageError:
        return _unsupported()
    while found and found[-1].text == ";":
        found.pop()
    words = [t.text.lower() if t.kind == "word" else t.text for t in found]
    if "returning" in words or not words:
        return _unsupported()
    body = _Body(text, found, words)
    made = {"select": body.select, "insert": body.insert, "delete": body.delete}.get(words[0], lambda: None)()
    return Translation(made) if made else _unsupported()


@dataclass
class _Body:
    text: str
    found: list[Token]
    words: list[str]

    def span(self, a: int, b: int) -> str:
        """The source between two tokens, as it stands."""
        return self.text[self.found[a].start : self.found[b - 1].end] if a < b else ""

    def at(self, word: str, start: int = 0) -> int:
        """Place of a word outside parentheses; -1 if there is none."""
        depth = 0
        for i in range(start, len(self.words)):
            depth += (self.words[i] == "(") - (self.words[i] == ")")
            if depth == 0 and self.words[i] == word and self.found[i].kind == "word":
                return i
        return -1

    def listed(self, a: int, b: int) -> str:
        """Comma-separated parts outside parentheses, trimmed; empty parts go."""
        parts, depth, start = [], 0, a
        for i in range(a, b):
            depth += (self.words[i] == "(") - (self.words[i] == ")")
            if depth == 0 and self.words[i] == ",":
                parts.append(self.span(start, i))
                start = i + 1
        return ",".join(p for p in (*parts, self.span(start, b)) if p)

    def select(self) -> str | None:
        n, source = len(self.words), self.at("from", 1)
        if source < 0:
            return "select 1" if self.words == ["select", "1"] else None
        where = self.at("where", source)
        end = n if where < 0 else where
        columns, table = self.listed(1, source), self.span(source + 1, end)
        if not columns or not table or where == n - 1:
            return None
        return f"select {columns} from {table}" + (f" where {self.span(where + 1, n)}" if where >= 0 else "")

    def closing(self, start: int) -> int:
        depth = 0
        for i in range(start, len(self.words)):
            depth += (self.words[i] == "(") - (self.words[i] == ")")
            if depth == 0:
                return i
        return -1

    def insert(self) -> str | None:
        n = len(self.words)
        if self.words[1:2] != ["into"] or n < 3:
            return None
        at = 2
        while at < n and self.words[at] != "(" and self.words[at] != "values":
            at += 1
        table, columns = self.span(2, at), ""
        if at < n and self.words[at] == "(":
            end = self.closing(at)
            columns, at = f" ({self.span(at + 1, end)})", end + 1
            if end < 0:
                return None
        if not table or self.words[at : at + 2] != ["values", "("] or self.closing(at + 1) != n - 1:
            return None
        return f"insert into {table}{columns} values ({self.span(at + 2, n - 1)})"

    def delete(self) -> str | None:
        n = len(self.words)
        if self.words[1:2] != ["from"]:
            return None
        where = self.at("where", 2)
        table = self.span(2, n if where < 0 else where)
        if not table or where == n - 1:
            return None
        return f"delete from {table}" + (f" where {self.span(where + 1, n)}" if where >= 0 else "")
