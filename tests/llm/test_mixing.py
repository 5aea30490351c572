import random

import numpy as np
import pytest

from lumenvec.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if w[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * level for s in sizes}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, None: 7, "é": 300}, {"x": 0, "y": 50}, {f"s{k}": (k * 37) % 101 for k in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    size = np.array([rng.randint(0, 500) for _ in range(800)], float)
    p = np.full(800, 0.37)
    mixing.fly(p, size, rng)
    assert ((p == 0) | (p == 1)).sum() >= 798
    assert p.sum() == pytest.approx(800 * 0.37) and p @ size == pytest.approx(0.37 * size.sum())
    mixing.land(p, size, 0.37 * size.sum())
    assert set(p) <= {0.0, 1.0} and abs(p @ size - 0.37 * size.sum()) <= size.max()


def test_inclusion_is_as_expected():
    size, took = np.array([1.0, 5, 9, 14, 2, 8, 8, 30] * 5), np.zeros(40)
    for k in range(400):
        p = np.full(40, 0.3)
        mixing.fly(p, size, random.Random(k))
        took += p
    assert np.abs(took / 400 - 0.3).max() < 0.1


def docs(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["src0"] * 4 + ["b", "c", None])) for k in range(1500)]
    rows += [(1, None, "b"), (7, "same same", "c"), (7, "same same", "c"), (None, "no id here", "b"), (9999, "long " * 20000, "src0")]
    return spark.createDataFrame([(i, t, s, 5) for i, t, s in rows], "doc_id long, text string, source string, size int")


def test_mix(spark):
    df = docs(spark)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    for s, n in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == n and r["target"] == pytest.approx(want[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(60, 0.02 * want[s])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df).collect()))
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixed_repeats_rows_and_keeps_columns(spark):
    df = docs(spark).where("doc_id < 300 or doc_id is null")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = {}
    for r in mixing.mix(df).collect():
        copies[(r["doc_id"], r["source"], r["size"])] = copies.get((r["doc_id"], r["source"], r["size"]), 0) + r["copies"]
    assert out.count() == sum(copies.values())


def test_clashing_names(spark):
    """Columns that are named as the operator's own come out as they went in."""
    names = "copies", "_id", "row", "doc", "size", "p", "rank", "_copy", "source_size", "target", "taken", "_size", "r_n"
    df = spark.createDataFrame([(k, "w " * (k % 17 + 1), "a", *range(-7, -7 + len(names))) for k in range(200)], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.distinct().exceptAll(df).count() == 0 and {r["_id"] for r in out.collect()} == {-6}
    assert sum(len(r["text"].split()) for r in out.collect()) == mixing.mix(df).agg({"taken": "sum"}).first()[0]


def test_as_many_sources_as_documents(spark, monkeypatch):
    """Sources beyond what may be sent to all tasks; ranks over several ranges."""
    monkeypatch.setattr(mixing, "MAX_SENT", 100)
    df = spark.range(600).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 as int)) as text", "concat('http://', id) as source")
    want = brute_targets({f"http://{k}": k % 7 for k in range(600)})
    got = mixing.mix(df).collect()
    assert len(got) == 600 and all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_rows_without_id_are_spread(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'a b c' as text", "'s' as source")
    got = mixing.mix(df).collect()
    assert len(got) == 3000 and abs(sum(r["taken"] for r in got) - 1.5 * 9000) <= 3


def test_rows_that_a_shuffle_deals_out(spark):
    df = docs(spark).where("doc_id between 10 and 400").join(spark.range(0, 1000, 2).withColumnRenamed("id", "doc_id"), "doc_id").repartition(6, "source")
    took = {}
    for r in mixing.mixed(df).collect():
        took[r["doc_id"]] = took.get(r["doc_id"], 0) + 1
    words = {r["doc_id"]: len(r["text"].split()) for r in df.collect()}
    goals = mixing.mix(df).groupBy().agg({"taken": "sum"}).first()[0]
    assert max(took.values()) <= 2 and abs(sum(words[i] * n for i, n in took.items()) - goals) <= 0.05 * goals


def test_levels(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "repeat('w ', cast(id % 97 as int)) as text", "'s' as source")
    got = mixing.mix(df.unionByName(df.selectExpr("doc_id + 10000 as doc_id", "text", "'t' as source")), weights=(3, 1))
    for s in ("s", "t"):
        own = got.where(f"source = '{s}'").selectExpr("sum(taken) t", "max(target) g").first()
        assert abs(own["t"] - own["g"]) <= 97
