"""Query syntax trees. str() of a query is its text again."""

from __future__ import annotations

from dataclasses import dataclass

Value = str | int | float | bool | None
RANGES = ("<", "<=", ">", ">=")


def literal(v: Value) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return f"'{v}'" if isinstance(v, str) else repr(v)


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Value

    def __str__(self) -> str:
        return f"{self.field} {self.op} {literal(self.value)}"


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[Value, ...]

    def __str__(self) -> str:
        return f"{self.field} IN ({', '.join(map(literal, self.values))})"


@dataclass(frozen=True)
class Between:
    field: str
    low: Value
    high: Value

    def __str__(self) -> str:
        return f"{self.field} BETWEEN {literal(self.low)} AND {literal(self.high)}"


@dataclass(frozen=True)
class Like:
    field: str
    pattern: str

    def __str__(self) -> str:
        return f"{self.field} LIKE {literal(self.pattern)}"


Predicate = Compare | In | Between | Like


@dataclass(frozen=True)
class Projected:
    """A metadata field in the output: under its own name, an alias, or through a function."""

    field: str
    alias: str | None = None
    function: str | None = None

    def __str__(self) -> str:
        return f"{self.function}({self.field})" if self.function else f"{self.field} AS {self.alias}" if self.alias else self.field


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[str, ...] = ()

    def __str__(self) -> str:
        return f"{self.name}({', '.join(a if a.replace('_', 'a').isalnum() and not a[:1].isdigit() else literal(a) for a in self.args)})"


@dataclass(frozen=True)
class Query:
    kind: str  # SIMILARITY or SEMANTIC
    field: str
    source: str | tuple[float, ...]  # a text to embed, or the vector itself
    where: tuple[Predicate, ...] = ()
    project: tuple[Projected, ...] = ()
    bias: Call | None = None
    order_by: Call | None = None
    descending: bool = False
    limit: int | None = None
    offset: int | None = None
    within_ms: int | None = None

    def __str__(self) -> str:
        source = literal(self.source) if isinstance(self.source, str) else f"VECTOR({', '.join(map(repr, self.source))})"
        parts = [f"FIND {self.kind}({self.field}, {source})"]
        if self.project:
            parts.append("PROJECT ON " + ", ".join(map(str, self.project)))
        if self.where:
            parts.append("WITH METADATA WHERE " + " AND ".join(map(str, self.where)))
        if self.bias:
            parts.append(f"BIAS {self.bias}")
        if self.order_by:
            parts.append(f"ORDER BY {self.order_by}{' DESC' if self.descending else ' ASC'}")
        for word, n, unit in (("LIMIT", self.limit, ""), ("OFFSET", self.offset, ""), ("WITHIN", self.within_ms, "ms")):
            if n is not None:
                parts.append(f"{word} {n}{unit}")
        return " ".join(parts)
