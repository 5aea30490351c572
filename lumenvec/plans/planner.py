"""From a syntax tree to a logical plan: candidates and bias strength by budget, cost and rejection, clause checks."""

from __future__ import annotations

import math
from collections.abc import Collection
from dataclasses import dataclass

from ..lang.ast import Between, Compare, In, Predicate, Query
from .nodes import Bias, BiasFilter, Deadline, Filter, Limit, Merge, Node, Scan, Sort

SCORINGS = ("score", "similarity", "recency", "popularity", "relevance_clicks", "personal")
MAX_LIMIT = 10_000


class PlanError(ValueError):
    pass


# The defaults, limits and budget formulas of the query language.
@dataclass(frozen=True)
class Settings:
    """Defaults of a planner. strict=True narrows to the plans that the query language first had: only a lone comparison biases, and its filter is then left out; filters and limits see the candidates only."""

    candidates: int = 50
    dim: int = 384
    records: int = 10_000
    cost_buffer: float = 0.2
    cost_per_distance_ms: float = 0.001
    alpha: float = 0.3
    merge: bool = False
    use_mask: bool = False
    filter_after: bool = False
    strict: bool = False
    max_limit: int = MAX_LIMIT


def dimension_of(field: str, dim: int) -> int:
    """A fixed dimension for a field name: a base-31 hash in 64 bits."""
    h = 0
    for b in field.encode():
        h = (h * 31 + b) % 2**64
    return h % dim


def weight_mask(where: tuple[Predicate, ...], dim: int) -> tuple[tuple[int, float], ...]:
    return tuple((dimension_of(p.field, dim), {"=": 1.0, "!=": 0.8}.get(p.op, 0.5)) for p in where if isinstance(p, Compare))


def _numeric(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def bias_filters(where: tuple[Predicate, ...]) -> tuple[BiasFilter, ...]:
    """Filters by which the query vector moves; !=, LIKE and other types move nothing. A list of categories moves it by each in turn."""
    out: list[BiasFilter] = []
    for p in where:
        if isinstance(p, Compare) and p.op != "!=":
            if _numeric(p.value):
                out.append(BiasFilter(p.field, float(p.value), p.op))
            elif isinstance(p.value, str) and p.op == "=":
                out.append(BiasFilter(p.field, p.value))
        elif isinstance(p, Between) and _numeric(p.low) and _numeric(p.high):
            out.append(BiasFilter(p.field, float(p.low), "range", float(p.high)))
        elif isinstance(p, In) and len(p.values) == 1 and isinstance(p.values[0], str):
            out.append(BiasFilter(p.field, p.values[0]))
    return tuple(out)


def candidates_for(settings: Settings, within_ms: int | None) -> int:
    if within_ms is None:
        return settings.candidates
    return int(min(200.0, max(10.0, settings.candidates * within_ms / 100)))


def cost_ms(settings: Settings, candidates: int) -> float:
    return candidates * settings.dim * 2 * math.log(settings.records) * settings.cost_per_distance_ms * (1 + settings.cost_buffer)


def covered(p: Predicate) -> bool:
    """In strict mode, a lone predicate that its own bias stands for."""
    return isinstance(p, Compare) and (p.op == "=" and isinstance(p.value, str) or p.op != "!=" and isinstance(p.value, float))


def plan(query: Query, settings: Settings = Settings(), extra: Collection[str] = ()) -> Node:  # noqa: B008  it is frozen
    """extra: names of scoring functions besides the built-in ones."""
    known = (*SCORINGS, *extra)
    if query.bias and query.order_by:
        raise PlanError("BIAS and ORDER BY exclude each other")
    for call in (query.bias, query.order_by):
        if call and call.name not in known:
            raise PlanError(f"there is no scoring function {call.name}; there are {', '.join(known)}")
    limit, offset = 10 if query.limit is None else query.limit, query.offset or 0
    if limit > settings.max_limit:
        raise PlanError(f"LIMIT {limit} is over {settings.max_limit}")
    if query.within_ms is not None and query.within_ms < 1:
        raise PlanError("WITHIN needs a millisecond at least")
    if any(p.field == query.field for p in query.project):
        raise PlanError(f"{query.field} is the vector, not metadata")
    budgeted = candidates_for(settings, query.within_ms)
    k = budgeted if settings.strict else max(budgeted, limit + offset)
    alpha = settings.alpha if query.within_ms is None else settings.alpha * min(1.0, max(0.0, query.within_ms / 100))
    where = query.where
    lone = len(where) == 1
    biases = bias_filters(where) if lone or not settings.strict else ()
    if query.project and not settings.strict:  # the fields to output are those that may bias
        biases = tuple(b for b in biases if b.field in {p.field for p in query.project})
    mask = weight_mask(where, settings.dim) if settings.use_mask and (lone or not settings.strict) else ()
    node: Node = Scan(query.field, k, mask, biases, alpha)
    if settings.merge:
        node = Merge(node, node, k)
    if where and not (settings.strict and lone and covered(where[0])):
        node = Filter(node, where, before=not (settings.filter_after or settings.strict))
    if query.bias:
        node = Bias(node, query.bias)
    if query.order_by:
        node = Sort(node, query.order_by, query.descending)
    node = Limit(node, limit, offset, query.project)
    if query.within_ms is not None:
        estimated = cost_ms(settings, budgeted)
        adjusted = estimated * (1 + settings.cost_buffer)
        if adjusted > query.within_ms:
            raise PlanError(f"the query would exceed its latency budget: about {adjusted:.1f}ms with buffer, {query.within_ms}ms allowed; ask for fewer candidates or leave WITHIN out")
        node = Deadline(node, query.within_ms, estimated)
    return node
