"""Metadata predicates as Column conditions.

Metadata are columns of the records, or fields of a JSON text or a VARIANT column. A missing field (null) makes every predicate false, != too.
Numbers compare as doubles (integer columns with whole numbers as integers); strings, booleans and nulls compare with their own kind only. LIKE knows % at both ends only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.ast import Between, Compare, In, Like, Predicate, Value

_EPS = 2.0**-52
_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


class Field:
    """A metadata field by type: its number, string and boolean, each null where the field has another type."""

    def __init__(self, number: Column, string: Column, boolean: Column, null: Column, kind: str | None = None) -> None:
        """kind: of a typed column; integer, float, string, boolean or other."""
        self.number, self.string, self.boolean, self.null, self.kind = number, string, boolean, null, kind

    @staticmethod
    def of_column(df: DataFrame, name: str) -> Field:
        kind, c, none = df.schema[name].dataType, F.col(name), F.lit(None)
        is_number, is_string, is_bool = isinstance(kind, T.NumericType), isinstance(kind, T.StringType), isinstance(kind, T.BooleanType)
        return Field(c if is_number else none.cast("double"), c if is_string else none.cast("string"), c if is_bool else none.cast("boolean"), F.lit(False), "integer" if isinstance(kind, T.IntegralType) else "float" if is_number else "string" if is_string else "boolean" if is_bool else "other")

    @staticmethod
    def of_variant(v: Column, name: str) -> Field:
        """A top-level field. The type is looked at first: extraction would turn texts into numbers."""
        path = f"$.{name}"
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        get = lambda cond, t: F.when(cond, F.try_variant_get(v, path, t))
        return Field(get(number, "double"), get(kind == "STRING", "string"), get(kind == "BOOLEAN", "boolean"), F.coalesce(kind == "VOID", F.lit(False)))


def fields_of(df: DataFrame, metadata: str | None = None) -> Callable[[str], Field]:
    """Resolves a name: a column of df, else a field of the metadata column (JSON text or VARIANT), else a field that is missing everywhere."""

    def field(name: str) -> Field:
        if name in df.columns:
            return Field.of_column(df, name)
        if metadata:
            c = F.col(metadata)
            return Field.of_variant(c if isinstance(df.schema[metadata].dataType, T.VariantType) else F.try_parse_json(c), name)
        none = F.lit(None)
        return Field(none.cast("double"), none.cast("string"), none.cast("boolean"), F.lit(False))

    return field


def _compared(f: Field, op: str, v: Value) -> Column:
    if v is None:
        return f.null if op in ("=", "<=", ">=") else F.lit(False)
    if isinstance(v, bool):
        return _OPS[op](f.boolean, F.lit(v))
    if isinstance(v, str):
        return _OPS[op](f.string, F.lit(v))
    # typed columns are compared as they are, which a Parquet scan can use; NaN counts as equal to all numbers
    c = f.number
    if f.kind == "integer":
        return _OPS[op](c, F.lit(int(v) if float(v).is_integer() and abs(v) < 2**63 else v))
    if f.kind == "float":
        out = _OPS[op](c, F.lit(v))
        return out | F.isnan(c.cast("double")) if op in ("=", "<=") else out & ~F.isnan(c.cast("double")) if op in (">", "!=") else out
    return F.when(F.isnan(c), op in ("=", "<=", ">=")).otherwise(_OPS[op](c, F.lit(float(v))))


def _one_of(f: Field, numbers: list[float]) -> Column:
    """Numbers by the tolerance of IN."""
    if f.kind == "integer":  # only whole numbers can be within it
        return f.number.isin([int(v) for v in numbers if float(v).is_integer()])
    if f.kind == "float":
        return f.number.isin([float(v) for v in numbers]) | reduce(lambda a, b: a | b, [(f.number > float(v) - _EPS) & (f.number < float(v) + _EPS) for v in numbers])
    return reduce(lambda a, b: a | b, [F.abs(f.number - F.lit(float(v))) < _EPS for v in numbers])


def like(s: Column, pattern: str) -> Column:
    """% at the ends matches anything; _ and an inner % are themselves."""
    if pattern in ("%", "%%"):
        return s.isNotNull()
    head, tail = pattern.endswith("%"), pattern.startswith("%")
    if head and tail:
        return s.contains(pattern[1:-1])
    return s.startswith(pattern[:-1]) if head else s.endswith(pattern[1:]) if tail else s == pattern


def condition(p: Predicate, field: Callable[[str], Field]) -> Column:
    f = field(p.field)
    if isinstance(p, Compare):
        out = _compared(f, p.op, p.value)
    elif isinstance(p, Between):
        out = _compared(f, ">=", p.low) & _compared(f, "<=", p.high)
    elif isinstance(p, Like):
        out = like(f.string, p.pattern)
    else:
        assert isinstance(p, In)
        texts = [v for v in p.values if isinstance(v, str)]
        numbers = [v for v in p.values if v is not None and not isinstance(v, (str, bool))]
        parts = [_compared(f, "=", v) for v in p.values if v is None or isinstance(v, bool)]
        if texts:
            parts.append(f.string.isin(texts))
        if numbers:
            parts.append(_one_of(f, numbers))
        out = reduce(lambda a, b: a | b, parts, F.lit(False)) if len(parts) != 1 else parts[0]
    return out  # in a where clause null is false already


def all_of(predicates: tuple[Predicate, ...], field: Callable[[str], Field]) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & condition(p, field)
    return out
