"""From a logical plan to one lazy DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.predicates import all_of, fields_of
from ..lang.ast import Call, Projected
from ..operators import search, stats
from .nodes import Bias, Deadline, Filter, Limit, Merge, Node, Scan, Sort, find
from .planner import PlanError

#: Days after which recency has fallen to 1/e.
RECENCY_DAYS = 30.0

PROJECTIONS: dict[str, Callable[[Column], Column]] = {"upper": F.upper, "lower": F.lower, "length": F.length, "abs": F.abs, "round": F.round, "floor": F.floor, "ceil": F.ceil, "year": F.year, "month": F.month}


@dataclass
class Sources:
    """What a query reads: records (id, a vector column, metadata as columns, or in a JSON or VARIANT column), hot records with the same
    columns, deleted ids, interactions (id, clicks, popularity, last_at), bucket bounds of numeric fields, and the fixed time that recency counts from."""

    records: DataFrame
    hot: DataFrame | None = None
    deleted: DataFrame | None = None
    interactions: DataFrame | None = None
    buckets: dict[str, Sequence[float]] = field(default_factory=dict)
    now: Column | None = None
    metric: str = "cosine"
    id_col: str = "id"
    metadata: str | None = None
    kept: stats.Kept | None = None  # statistics for query bias; without them each biased query aggregates the records
    extra: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)  # further scoring functions: from candidates with similarity to the same with rank


def query_vector(plan: Node, s: Sources, q: Sequence[float], footprint: Sequence[float] | None, personal: bool) -> list[float]:
    """Footprint once, then the bias of the scan's filters. The statistics are as many numbers as there are dimensions."""
    scan = find(plan, Scan)
    out = [float(x) for x in q]
    if personal and footprint:
        out = [x * f for x, f in zip(out, footprint, strict=False)]
    if scan.bias and scan.alpha:
        terms = stats.bias_terms(s.records, scan.bias, scan.alpha, s.buckets, scan.field, s.kept)
        for r in terms.collect() if terms is not None else []:
            if r["d"] < len(out) and r["shift"] is not None:
                out[r["d"]] += r["shift"]
    return out


def rescored(df: DataFrame, call: Call, s: Sources) -> DataFrame:
    """Adds rank_score, a similarity (higher is better) changed by a scoring function."""
    similarity = F.lit(1.0) - F.col("score")
    if call.name in s.extra:
        return s.extra[call.name](df.withColumn("similarity", similarity))
    if call.name == "personal":  # the query vector has it
        return df.withColumn("rank_score", similarity)
    seen = s.interactions
    if seen is None:
        raise PlanError(f"{call.name} needs interactions")
    joined = df.join(seen.select(F.col("id").alias(s.id_col), "clicks", "popularity", "last_at"), s.id_col, "left")  # candidates only, a few hundred rows
    if call.name == "recency":
        days = (F.unix_timestamp(s.now if s.now is not None else F.current_timestamp()) - F.unix_timestamp("last_at")) / F.lit(86400.0)
        factor = F.coalesce(F.exp(-days / F.lit(RECENCY_DAYS)), F.lit(0.0))
    else:
        n = F.coalesce(F.col("popularity" if call.name == "popularity" else "clicks"), F.lit(0))
        factor = F.lit(1.0) + F.log(F.lit(1.0) + n)
    return joined.withColumn("rank_score", similarity * factor).drop("clicks", "popularity", "last_at")


def outputs(df: DataFrame, project: Sequence[Projected], s: Sources) -> list[Column]:
    resolve = fields_of(df, s.metadata)

    def column(name: str) -> Column:
        if name in df.columns:
            return F.col(name)
        f = resolve(name)
        return F.coalesce(f.string, f.number.cast("string"), f.boolean.cast("string"))

    out = []
    for p in project:
        c = column(p.field)
        if p.function:
            if p.function.lower() not in PROJECTIONS:
                raise PlanError(f"there is no function {p.function}; there are {', '.join(PROJECTIONS)}")
            c = PROJECTIONS[p.function.lower()](c)
        out.append(c.alias(p.alias or (f"{p.function}_{p.field}" if p.function else p.field)))
    return out


def compiled(plan: Node, s: Sources, q: Sequence[float] | Column, footprint: Sequence[float] | None = None, semantic: bool = False) -> DataFrame:
    """id, score and metadata (or the projected fields), in the order of the result. q as a Column is taken as it is (no footprint, no bias)."""
    scan, merge, condition = find(plan, Scan), find(plan, Merge), find(plan, Filter)
    bias, sort, limit = find(plan, Bias), find(plan, Sort), find(plan, Limit)
    if scan.field not in s.records.columns or not s.records.schema[scan.field].dataType.typeName() == "array":
        raise PlanError(f"{scan.field} is not a vector column of the records")
    vector = q if isinstance(q, Column) else V.literal(query_vector(plan, s, q, footprint, semantic or bool(bias and bias.call.name == "personal")))

    def part(records: DataFrame) -> DataFrame:
        if s.deleted is not None:
            records = search.without(records, s.deleted, s.id_col)
        if condition and condition.before:
            records = records.where(all_of(condition.predicates, fields_of(records, s.metadata)))
        mask = V.dense(dict(scan.mask), max([d for d, _ in scan.mask], default=0) + 1 if isinstance(q, Column) else len(q)) if scan.mask else None
        return search.nearest(search.scored(records, vector, s.metric, scan.field, mask), scan.candidates, id_col=s.id_col)

    if merge and s.hot is not None:  # a hot record stands for its older version in the base
        df = search.merge(part(search.without(s.records, s.hot, s.id_col)), part(s.hot), k=scan.candidates, id_col=s.id_col)
    else:
        df = part(s.records)
    if condition and not condition.before:
        df = df.where(all_of(condition.predicates, fields_of(df, s.metadata)))
    order = [F.col("score").asc(), F.col(s.id_col)]
    if call := bias.call if bias else sort.call if sort and sort.call.name not in ("score", "similarity") else None:
        df = rescored(df, call, s)
        order = [F.col("rank_score").asc() if sort and not sort.descending else F.col("rank_score").desc(), F.col(s.id_col)]
    elif sort:
        order[0] = F.col("score").desc() if sort.descending else F.col("score").asc()
    # the order stays that of ids and scores; what is not asked for isn't read
    df = df.orderBy(*order).offset(limit.offset).limit(limit.limit)
    rest = outputs(df, limit.project, s) if limit.project else [F.col(c) for c in df.columns if c not in (s.id_col, "score", "rank_score", scan.field)]
    return df.select(F.col(s.id_col), F.col("score"), *([F.col("rank_score")] if "rank_score" in df.columns else []), *rest)


def keep_within(n: int, budget_ms: float, elapsed_ms: float) -> int:
    """Rows that a late result keeps."""
    return n if elapsed_ms <= budget_ms else math.ceil(n * budget_ms / elapsed_ms)


__all__ = ["Deadline", "Sources", "compiled", "keep_within", "query_vector", "rescored"]
