"""Logical plans: a linear tree with one scan (two under a merge) at the bottom."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..lang.ast import Call, Predicate, Projected


@dataclass(frozen=True)
class BiasFilter:
    """A predicate by which the query vector is shifted: a category, or a numeric value with =, <, <=, >, >= or a range to high."""

    field: str
    value: str | float
    op: str = "="
    high: float | None = None


@dataclass(frozen=True)
class Scan:
    field: str
    candidates: int
    mask: tuple[tuple[int, float], ...] = ()
    bias: tuple[BiasFilter, ...] = ()
    alpha: float = 0.0

    def label(self) -> str:
        mask = f" [mask: {len(self.mask)} dims]" if self.mask else ""
        return f"Scan {self.field}, candidates: {self.candidates}{mask}" + (f" [bias: alpha={self.alpha:g}, {len(self.bias)} filters]" if self.bias else "")


@dataclass(frozen=True)
class Merge:
    """Hot and base records, each id once with its smallest distance."""

    left: Scan
    right: Scan
    limit: int

    def label(self) -> str:
        return f"Merge limit: {self.limit}"


@dataclass(frozen=True)
class Filter:
    input: Node
    predicates: tuple[Predicate, ...]
    before: bool = True  # filters the records, else the candidates

    def label(self) -> str:
        return f"Filter {' AND '.join(map(str, self.predicates))} ({'before' if self.before else 'after'} the scan)"


@dataclass(frozen=True)
class Bias:
    input: Node
    call: Call

    def label(self) -> str:
        return f"Bias {self.call}"


@dataclass(frozen=True)
class Sort:
    input: Node
    call: Call
    descending: bool

    def label(self) -> str:
        return f"Sort {self.call} {'desc' if self.descending else 'asc'}"


@dataclass(frozen=True)
class Limit:
    input: Node
    limit: int
    offset: int
    project: tuple[Projected, ...] = ()

    def label(self) -> str:
        return f"Limit {self.limit}, offset: {self.offset}" + (f", project: {', '.join(map(str, self.project))}" if self.project else "")


@dataclass(frozen=True)
class Deadline:
    input: Node
    millis: int
    estimated_ms: float

    def label(self) -> str:
        return f"Deadline {self.millis} ms, estimated: {self.estimated_ms:.1f} ms"


Node = Scan | Merge | Filter | Bias | Sort | Limit | Deadline


def tree(node: Node, depth: int = 0) -> str:
    """The plan as indented text."""
    below = [node.left, node.right] if isinstance(node, Merge) else [] if isinstance(node, Scan) else [node.input]
    return "\n".join(["  " * depth + node.label(), *(tree(x, depth + 1) for x in below)])


def find(node: Node, kind: type) -> Node | None:
    while not isinstance(node, kind):
        if isinstance(node, Scan):
            return None
        node = node.left if isinstance(node, Merge) else node.input
    return node


__all__ = ["Bias", "BiasFilter", "Deadline", "Filter", "Limit", "Merge", "Node", "Scan", "Sort", "find", "replace", "tree"]
