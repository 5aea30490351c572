"""Query texts: what is accepted and rejected, round trips, plans."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenvec.lang.ast import Between, Call, Compare, In, Like, Projected, Query
from lumenvec.lang.parser import QuerySyntaxError, parse
from lumenvec.plans import planner
from lumenvec.plans.nodes import Bias, BiasFilter, Deadline, Filter, Limit, Merge, Scan, Sort, find, tree
from lumenvec.plans.planner import PlanError, Settings, plan

S = "FIND SIMILARITY(emb, 'x')"


@pytest.mark.parametrize(("text", "part", "value"), [
    ("FIND SIMILARITY(emb, VECTOR(0.1, 0.2))", "source", (0.1, 0.2)), ("FIND SIMILARITY(emb, VECTOR())", "source", ()), ("FIND SEMANTIC(emb, '')", "kind", "SEMANTIC"),
    ("find similarity( emb , VECTOR(-1, 2e3) )", "source", (-1.0, 2000.0)),
    (f"{S} WITH METADATA WHERE color = 'red'", "where", (Compare("color", "=", "red"),)), (f"{S} WITH METADATA WHERE a >= 2024 AND b != 2.5 AND c = true AND d = null", "where", (Compare("a", ">=", 2024), Compare("b", "!=", 2.5), Compare("c", "=", True), Compare("d", "=", None))),
    (f"{S} WITH METADATA WHERE c IN ('a', 1, 2.0) AND y BETWEEN 2020 AND 2025 AND k LIKE 'ita%'", "where", (In("c", ("a", 1, 2.0)), Between("y", 2020, 2025), Like("k", "ita%"))),
    (f"{S} WITH METADATA WHERE c IN ()", "where", (In("c", ()),)), (f"{S} LIMIT 999999", "limit", 999999), (f"{S} OFFSET 100 LIMIT 50", "offset", 100), (f"{S} WITHIN 100ms", "within_ms", 100), (f"{S} EN 100 ms", "within_ms", 100),
    (f"{S} PROJECT ON year, category AS cat, avg(price)", "project", (Projected("year"), Projected("category", "cat"), Projected("price", function="avg"))), (f"{S} BIAS relevance_clicks(user_id, scope)", "bias", Call("relevance_clicks", ("user_id", "scope"))),
    (f"{S} ORDER BY score()", "descending", False), (f"{S} ORDER BY similarity('emb', 'q') DESC", "descending", True),
])
def test_accepts(text, part, value):
    assert getattr(parse(text), part) == value


@pytest.mark.parametrize("text", [
    "", "FIND", "FIND OTHER(e, 'x')", "FIND SIMILARITY(e)", "FIND SIMILARITY(e, 'x", f"{S} OFFSET 3", f"{S} WITHIN 100", f"{S} EN 5", f"{S} LIMIT 1 LIMIT 2", f"{S} WITHIN 1ms EN 2ms", f"{S} junk", f"{S} LIMIT -1", f"{S} LIMIT 1.5",
    f"{S} WITH METADATA WHERE", f"{S} WITH METADATA WHERE a", f"{S} WITH METADATA WHERE a = 1 OR b = 2", f"{S} WITH METADATA WHERE a->>'b' = 1", "FIND SIMILARITY(e, [0.1, 0.2])", f"{S} BIAS recency", f"{S} PROJECT ON", f"{S} LIMIT 1 ;",
])
def test_rejects(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_errors_have_a_place():
    with pytest.raises(QuerySyntaxError) as e:
        parse("FIND SIMILARITY(e, 'x')\n  LIMIT many")
    assert (e.value.line, e.value.col) == (2, 9)


names = st.from_regex(r"[a-z_][a-z0-9_]{0,6}", fullmatch=True).filter(lambda s: s.upper() not in {"IN", "AND", "AS", "LIKE", "BETWEEN", "TRUE", "FALSE", "NULL", "EN", "BIAS", "LIMIT", "ORDER", "WITH", "VECTOR", "DESC", "ASC", "MS", "BY", "ON", "WHERE", "WITHIN", "OFFSET", "PROJECT"})
texts = st.text(st.characters(exclude_characters="'", exclude_categories=("Cs",)), max_size=8)
values = st.one_of(texts, st.integers(-(10**12), 10**12), st.floats(allow_nan=False, allow_infinity=False), st.booleans(), st.none())
predicates = st.one_of(st.builds(Compare, names, st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), values), st.builds(In, names, st.lists(values, max_size=3).map(tuple)), st.builds(Between, names, values, values), st.builds(Like, names, texts))
some = st.integers(0, 10**6)


@settings(max_examples=300, deadline=None)
@given(st.builds(
    Query, st.sampled_from(["SIMILARITY", "SEMANTIC"]), names, st.one_of(texts, st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=4).map(tuple)), st.lists(predicates, max_size=3).map(tuple),
    st.lists(st.one_of(st.builds(Projected, names), st.builds(Projected, names, alias=names), st.builds(Projected, names, function=names)), max_size=3).map(tuple), st.none() | st.builds(Call, names, st.lists(names, max_size=2).map(tuple)), limit=some, offset=st.none() | some, within_ms=st.none() | some,
))
def test_text_of_a_tree_parses_to_it(q):
    assert parse(str(q)) == q


def test_plan_order_and_defaults():
    node = plan(parse(f"{S} WITH METADATA WHERE category = 'a' BIAS recency() LIMIT 5 WITHIN 3000ms"), Settings())
    assert [type(node), type(node.input), type(node.input.input), type(node.input.input.input), type(node.input.input.input.input)] == [Deadline, Limit, Bias, Filter, Scan]
    assert [line.split()[0] for line in tree(node).split("\n")] == ["Deadline", "Limit", "Bias", "Filter", "Scan"]
    bare = plan(parse(S))
    assert (bare.limit, bare.offset, find(bare, Scan).candidates) == (10, 0, 50)
    assert isinstance(find(plan(parse(S), Settings(merge=True)), Merge), Merge)
    assert find(plan(parse(f"{S} ORDER BY score() DESC")), Sort).descending


def test_budget_sets_candidates_and_alpha_and_rejects():
    s = Settings(dim=4, records=100)
    assert find(plan(parse(f"{S} WITHIN 200ms"), s), Scan).candidates == 100
    assert planner.candidates_for(s, 1) == 10 and planner.candidates_for(s, 10_000) == 200
    assert find(plan(parse(f"{S} WITH METADATA WHERE a = 'b' WITHIN 50ms"), s), Scan).alpha == pytest.approx(0.15)
    with pytest.raises(PlanError, match="latency budget.*1ms"):
        plan(parse(f"{S} WITHIN 1ms"))
    assert planner.cost_ms(Settings(), 50) == pytest.approx(50 * 384 * 2 * 9.210340371976184 * 0.001 * 1.2)


def test_candidates_cover_the_page():
    assert find(plan(parse(f"{S} LIMIT 50 OFFSET 100")), Scan).candidates == 150
    assert find(plan(parse(f"{S} LIMIT 50 OFFSET 100"), Settings(strict=True)), Scan).candidates == 50


def test_bias_filters():
    where = parse(f"{S} WITH METADATA WHERE a = 'b' AND y >= 2020 AND z BETWEEN 1 AND 2 AND n != 3 AND k LIKE 'x%'").where
    assert planner.bias_filters(where) == (BiasFilter("a", "b"), BiasFilter("y", 2020.0, ">="), BiasFilter("z", 1.0, "range", 2.0))
    strict = plan(parse(f"{S} WITH METADATA WHERE a = 'b' AND y >= 2020"), Settings(strict=True))
    assert find(strict, Scan).bias == () and not find(strict, Filter).before
    lone = plan(parse(f"{S} WITH METADATA WHERE a = 'b'"), Settings(strict=True))
    assert find(lone, Filter) is None and len(find(lone, Scan).bias) == 1
    whole = plan(parse(f"{S} WITH METADATA WHERE y >= 2020"), Settings(strict=True))
    assert find(whole, Filter) is not None


def test_masks():
    where = parse(f"{S} WITH METADATA WHERE a = 1 AND b != 2 AND c < 3 AND d IN (1)").where
    assert [w for _, w in planner.weight_mask(where, 384)] == [1.0, 0.8, 0.5]
    assert planner.dimension_of("ab", 384) == (97 * 31 + 98) % 384


@pytest.mark.parametrize("text", [f"{S} BIAS recency() ORDER BY score()", f"{S} BIAS other()", f"{S} ORDER BY other()", f"{S} LIMIT 10001", f"{S} WITHIN 0ms", f"{S} PROJECT ON emb"])
def test_plan_errors(text):
    with pytest.raises(PlanError):
        plan(parse(text))
