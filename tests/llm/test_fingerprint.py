import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.llm import fingerprint as fp


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def brute_edits(rows):
    """rows in their order: the text that follows, and the edited text."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, t, nxt, t[: len(t) - half] + nxt[:half]))
    return out


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(300)]
    return [" ".join(rng.choice(words[: rng.choice((40, 300))]) for _ in range(rng.randint(1, 120))) for _ in range(n)]


def test_gamma_quantiles():
    assert np.mean(fp._R) == pytest.approx(2, abs=0.02) and np.var(fp._R) == pytest.approx(2, abs=0.1)


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(5)
    base = texts(150, 1)
    rows = []
    for k, t in enumerate(base):
        w = t.split()
        keep = rng.random()
        rows.append((k, t, " ".join([x for x in w if rng.random() < keep] + rng.choices(w, k=len(w) // 3))))
    both = spark.createDataFrame([(2 * k, a) for k, a, _ in rows] + [(2 * k + 1, b) for k, _, b in rows], "k long, t string")
    got = {r["k"]: r["fingerprint"] for r in fp.fingerprints(both, ["k"], "t").collect()}
    pairs = spark.createDataFrame([(k, got[2 * k], got[2 * k + 1]) for k, _, _ in rows], "k long, a string, b string")
    near = {r["k"]: r["n"] for r in pairs.select("k", fp.likeness(F.col("a"), F.col("b")).alias("n")).collect()}
    error = np.array([near[k] - jaccard(a, b) for k, a, b in rows])
    assert abs(error.mean()) < 0.02 and np.sqrt((error**2).mean()) < 0.11  # 32 samples: 0.088 at most, on average


@pytest.mark.parametrize("part_chars", [1 << 24, 2000])
def test_edits(spark, part_chars):
    rows = [(k * 3, t) for k, t in enumerate(texts(60, 2))] + [(200, None), (201, ""), (202, "é" * 5000), (203, "one two"), (203, "one two"), (-5, "first of all")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, row int")
    got = fp.edits(df, part_chars=part_chars).collect()
    want = brute_edits(sorted(rows, key=lambda r: -r[0]))
    key = lambda i, n, s: (i, n, s)
    assert sorted(key(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(key(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, _, e in want)
    prints = {}
    for r in got:
        assert len(r["fingerprint"]) == fp.SAMPLES * fp.DIGITS and 0 <= r["near_edited"] <= 1
        t = next(t for i, t in rows if i == r["doc_id"])
        assert prints.setdefault((t or "").strip(), r["fingerprint"]) == r["fingerprint"]
    by = {r["doc_id"]: r for r in got}
    assert by[200]["fingerprint"] == by[201]["fingerprint"] == "-" * (fp.SAMPLES * fp.DIGITS) and by[201]["near_next"] == 1.0
    err = [by[i]["near_edited"] - jaccard(t, e) for i, t, _, e in want] + [by[i]["near_next"] - jaccard(t, n) for i, t, n, _ in want if i != 203]
    assert np.sqrt(np.mean(np.square(err))) < 0.11


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    r = fp.edits(df).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()
    assert fp.edits(df.limit(0)).collect() == []
    two = fp.edits(df.unionByName(spark.createDataFrame([(None, "x y z w")], "doc_id long, text string"))).collect()
    assert {x["doc_id"] for x in two} == {1, None}


def test_rows_without_id_are_dealt_like_others(spark):
    df = spark.createDataFrame([(None, t) for t in texts(60, 9)], "doc_id long, text string")
    got = fp.edits(df, part_chars=500)
    assert got.count() == 60 and got.select("edited_sha256").distinct().count() == 60


def test_against_sql(spark, sf):
    """Every column of the contract but the fingerprints, by SQL."""
    want = duckdb.execute(f"""
        with d as (select doc_id, coalesce(text, '') as t from '{sf}/documents.parquet'),
        n as (select *, coalesce(lead(t) over w, first_value(t) over w) as nxt, length(t) // 2 as half from d window w as (order by doc_id desc rows between unbounded preceding and unbounded following))
        select doc_id, length(t), sha256(left(t, length(t) - half) || left(nxt, half)) from n order by doc_id""").fetchall()
    got = fp.edits(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_chars", "edited_sha256").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_native(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    text = fp.edits(df)._jdf.queryExecution().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))
