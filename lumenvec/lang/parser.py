"""Recursive descent from query text to a syntax tree.

Clauses may come in any order, each once. Keywords are case-insensitive; numbers may have a sign, a fraction and an exponent; strings have
no escapes. OFFSET needs LIMIT; WITHIN and EN are one clause, in whole milliseconds.
"""

from __future__ import annotations

import re

from .ast import Between, Call, Compare, In, Like, Predicate, Projected, Query, Value

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<string>'[^']*')|(?P<number>[+-]?(?:\d+\.\d+|\d+\.(?!\w)|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)|(?P<op>!=|<=|>=|[=<>(),])""",
    re.X,
)


class QuerySyntaxError(ValueError):
    """Has the place of the error: line and col, from 1."""

    def __init__(self, message: str, text: str, at: int) -> None:
        self.line = text.count("\n", 0, at) + 1
        self.col = at - text.rfind("\n", 0, at)
        super().__init__(f"line {self.line}, column {self.col}: {message}")


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.k = text, [], 0
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QuerySyntaxError(f"unexpected {text[at]!r}", text, at)
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))

    def fail(self, wanted: str) -> QuerySyntaxError:
        _, found, at = self.tokens[self.k]
        return QuerySyntaxError(f"expected {wanted}, found {found or 'the end'!r}", self.text, at)

    def sees(self, *words: str) -> bool:
        return all(kind == "name" and t.upper() == w for (kind, t, _), w in zip(self.tokens[self.k : self.k + len(words)], words, strict=False))

    def take(self, kind: str, wanted: str | None = None) -> str:
        k, t, _ = self.tokens[self.k]
        if k != kind or kind == "op" and t != wanted:
            raise self.fail(wanted or kind)
        self.k += 1
        return t

    def words(self, *words: str) -> None:
        for w in words:
            if not self.sees(w):
                raise self.fail(w)
            self.k += 1

    def accept(self, op: str) -> bool:
        if self.tokens[self.k][:2] == ("op", op):
            self.k += 1
            return True
        return False

    def listed(self, item, empty: bool = False) -> list:
        """Items in parentheses."""
        self.take("op", "(")
        if empty and self.accept(")"):
            return []
        out = [item()]
        while self.accept(","):
            out.append(item())
        self.take("op", ")")
        return out

    def number(self) -> int | float:
        t = self.take("number")
        return float(t) if re.search(r"[.eE]", t) else int(t)

    def whole(self) -> int:
        k, t, _ = self.tokens[self.k]
        if k != "number" or not t.isdigit():
            raise self.fail("a whole number")
        self.k += 1
        return int(t)

    def value(self) -> Value:
        kind, t, _ = self.tokens[self.k]
        if kind == "string":
            self.k += 1
            return t[1:-1]
        if kind == "number":
            return self.number()
        for word, v in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.sees(word):
                self.k += 1
                return v
        raise self.fail("a literal")

    def predicate(self) -> Predicate:
        field = self.take("name")
        if self.sees("IN"):
            self.k += 1
            return In(field, tuple(self.listed(self.value, empty=True)))
        if self.sees("BETWEEN"):
            self.k += 1
            low = self.value()
            self.words("AND")
            return Between(field, low, self.value())
        if self.sees("LIKE"):
            self.k += 1
            return Like(field, self.take("string")[1:-1])
        kind, op, _ = self.tokens[self.k]
        if kind != "op" or op not in ("=", "!=", "<", ">", "<=", ">="):
            raise self.fail("a comparison")
        self.k += 1
        return Compare(field, op, self.value())

    def projected(self) -> Projected:
        name = self.take("name")
        if self.accept("("):
            field = self.take("name")
            self.take("op", ")")
            return Projected(field, function=name)
        if self.sees("AS"):
            self.k += 1
            return Projected(name, alias=self.take("name"))
        return Projected(name)

    def call(self, strings: bool) -> Call:
        arg = lambda: self.take("string")[1:-1] if strings and self.tokens[self.k][0] == "string" else self.take("name")
        return Call(self.take("name"), tuple(self.listed(arg, empty=True)))

    def query(self) -> Query:
        self.words("FIND")
        if not (self.sees("SIMILARITY") or self.sees("SEMANTIC")):
            raise self.fail("SIMILARITY or SEMANTIC")
        kind = self.take("name").upper()
        self.take("op", "(")
        field = self.take("name")
        self.take("op", ",")
        if self.sees("VECTOR"):
            self.k += 1
            source = tuple(float(x) for x in self.listed(self.number, empty=True))
        else:
            source = self.take("string")[1:-1]
        self.take("op", ")")
        found: dict = {}

        def put(name: str, v: object) -> None:
            if name in found:
                self.k -= 1
                raise self.fail(f"only one {name.replace('_', ' ').upper()} clause")
            found[name] = v

        while self.tokens[self.k][0] != "end":
            if self.sees("WITH"):
                self.words("WITH", "METADATA", "WHERE")
                all_ = [self.predicate()]
                while self.sees("AND"):
                    self.k += 1
                    all_.append(self.predicate())
                put("where", tuple(all_))
            elif self.sees("PROJECT"):
                self.words("PROJECT", "ON")
                some = [self.projected()]
                while self.accept(","):
                    some.append(self.projected())
                put("project", tuple(some))
            elif self.sees("BIAS"):
                self.k += 1
                put("bias", self.call(strings=False))
            elif self.sees("ORDER"):
                self.words("ORDER", "BY")
                put("order_by", self.call(strings=True))
                if self.sees("DESC") or self.sees("ASC"):
                    found["descending"] = self.take("name").upper() == "DESC"
            elif self.sees("LIMIT") or self.sees("OFFSET"):
                put(self.take("name").lower(), self.whole())
            elif self.sees("WITHIN") or self.sees("EN"):
                self.k += 1
                n = self.whole()
                if not self.sees("MS"):
                    raise self.fail("ms")
                self.k += 1
                put("within_ms", n)
            else:
                raise self.fail("a clause or the end")
        if "offset" in found and "limit" not in found:
            raise self.fail("LIMIT with OFFSET")
        return Query(kind, field, source, **found)


def parse(text: str) -> Query:
    return _Parser(text).query()
