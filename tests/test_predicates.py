"""Predicates against a plain model, on columns and on JSON; plans of searches."""

import json
import random

import pytest

from lumenvec.functions.predicates import all_of, fields_of
from lumenvec.lang.ast import Between, Compare, In, Like
from lumenvec.plans.compile import Sources, compiled
from lumenvec.plans.planner import Settings, plan
from lumenvec.lang.parser import parse

MISSING = object()


def number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def compared(a, op, b):
    if b is None:
        return a is None and op in ("=", "<=", ">=")
    if a is None or number(a) != number(b) or not number(a) and type(a) is not type(b):
        return False
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def model(p, row):
    a = row.get(p.field, MISSING)
    if a is MISSING:
        return False
    if isinstance(p, Compare):
        return compared(a, p.op, p.value)
    if isinstance(p, Between):
        return compared(a, ">=", p.low) and compared(a, "<=", p.high)
    if isinstance(p, In):
        return any(compared(a, "=", v) for v in p.values)
    if not isinstance(a, str):
        return False
    head, tail = p.pattern.endswith("%"), p.pattern.startswith("%")
    body = p.pattern.strip("%")
    return True if not body and (head or tail) else body in a if head and tail else a.startswith(body) if head else a.endswith(body) if tail else a == body


VALUES = [0, 1, 2, 2.5, -3, "a", "ab", "b_", "1", "", True, False, None]


def test_against_the_model(spark):
    rng = random.Random(4)
    rows = [{k: rng.choice(VALUES) for k in "xyz" if rng.random() < 0.8} for _ in range(60)]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "id long, metadata string").persist()
    ps = []
    for _ in range(40):
        f = rng.choice("xyz")
        ps.append(rng.choice((
            Compare(f, rng.choice(("=", "!=", "<", "<=", ">", ">=")), rng.choice(VALUES)), In(f, tuple(rng.sample(VALUES, 3))), Between(f, rng.choice([0, 1, "a"]), rng.choice([2, 2.5, "b"])), Like(f, rng.choice(["a%", "%b", "%a%", "%", "a", "%%", "_%", "b_"])),
        )))
    from pyspark.sql import functions as F

    field = fields_of(df, "metadata")
    got = df.select("id", *[F.coalesce(all_of((p,), field), F.lit(False)).alias(f"p{k}") for k, p in enumerate(ps)]).collect()
    for r in got:
        for k, p in enumerate(ps):
            assert r[f"p{k}"] == model(p, rows[r["id"]]), (p, rows[r["id"]])


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.range(200).selectExpr("id", "array(cast(id as double), 1D) as vector", "id % 5 as year", "concat('c', id % 3) as category", "repeat('x', 50) as unused").write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(stored):
    df = compiled(plan(parse("FIND SIMILARITY(vector, VECTOR(1.0, 0.0)) WITH METADATA WHERE year >= 2 AND category = 'c1' PROJECT ON category LIMIT 3"), Settings(dim=2, alpha=0.0)), Sources(stored), [1.0, 0.0])
    text = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(year,2)" in text and "EqualTo(category,c1)" in text
    assert "unused" not in text.split("ReadSchema:")[1].split("\n")[0] and "TakeOrderedAndProject" in text
    assert "Exchange" not in text.split("== Physical Plan ==")[1]


def test_strict_mode_drops_a_covered_filter(stored):
    text = "FIND SIMILARITY(vector, VECTOR(1.0, 0.0)) WITH METADATA WHERE category = 'c1' LIMIT 50"
    strict = compiled(plan(parse(text), Settings(dim=2, alpha=0.0, strict=True)), Sources(stored), [1.0, 0.0])
    assert {r["category"] for r in strict.collect()} == {"c0", "c1", "c2"}
    ours = compiled(plan(parse(text), Settings(dim=2, alpha=0.0)), Sources(stored), [1.0, 0.0])
    assert {r["category"] for r in ours.collect()} == {"c1"}


def test_in_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 10, "a", 0.5), (2, 20, "b", 1.5), (3, 2**60 + 1, "c", float("nan"))], "id long, n long, s string, x double").write.parquet(path)
    df = spark.read.parquet(path)

    def where(text):
        return df.where(all_of(parse(f"FIND SIMILARITY(v, '') WITH METADATA WHERE {text}").where, fields_of(df)))

    for text, ids, pushed in (("n IN (10, 20.0, 7.5)", [1, 2], "In(n"), ("s IN ('a', 'c')", [1, 3], "In(s"), ("x IN (0.5, 7)", [1], "x"), (f"n = {2**60 + 1}", [3], "EqualTo(n"), (f"n = {2**60}", [], "EqualTo(n"), ("n >= 20.0", [2, 3], "GreaterThanOrEqual(n")):
        found = where(text)
        assert sorted(r["id"] for r in found.collect()) == ids, text
        plan = found._jdf.queryExecution().toString()
        assert pushed in plan.split("PushedFilters: [")[-1].split("]")[0], text


def test_nan_in_a_typed_column_is_equal_to_all_numbers(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "id long, x double")
    for op, ids in (("=", [1]), ("!=", [2]), ("<", [2]), (">", []), ("<=", [1, 2]), (">=", [1])):
        got = df.where(all_of(parse(f"FIND SIMILARITY(v, '') WITH METADATA WHERE x {op} 5").where, fields_of(df)))
        assert sorted(r["id"] for r in got.collect()) == ids, op
