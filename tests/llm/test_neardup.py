import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.llm import neardup


def brute(rows, percent=85, width=5):
    """doc_id -> (n_shingles, component_id) for rows with distinct ids."""
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=0, families=12, copies=14, loners=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, i = [], 1
    for _ in range(families):
        base = [word() for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5, 8))):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w).title() if rng.random() < 0.1 else "\n".join(w)))
            i += rng.randint(1, 3)
    rows += [(i + k, " ".join(word() for _ in range(rng.randint(1, 80)))) for k in range(loners)]
    rng.shuffle(rows)
    return rows


def classes(spark, rows):
    df = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, component_id string, kept boolean")
    return neardup.classify(df).collect()


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = classes(spark, rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_large_family_of_partial_links(spark):
    """Many copies of one text, edited so much that most pairs are no links, though many are nearly."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i * 2, " ".join(w)))
    got = classes(spark, rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_chains_are_components(spark):
    w = [f"c{k}" for k in range(200)]
    rows = []
    for i in range(30):  # each is near the one before, far from the first
        rows.append((100 - i, " ".join(w)))
        w[(7 * i) % 200] = f"d{i}"
    got = {r["doc_id"]: r["component_id"] for r in classes(spark, rows)}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_cases(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (3, "ONE  two"), (9, "one two three"), (4, "é É"), (2, "É é"), (11, "a b c d e"), (10, "A B C D E"), (12, "x y z " * 30000), (13, "x y z " * 29000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in classes(spark, rows)}
    assert got[5] == (0, 5, True) and got[6] == (0, 6, True) and got[7] == (0, 7, True)
    assert got[8] == (1, 3, False) and got[3] == (1, 3, True) and got[9] == (1, 9, True)
    assert got[4] == (1, 4, True) and got[2] == (1, 2, True)  # only A-Z are lower-cased
    assert got[11][1] == got[10][1] == 10 and got[13][1] == got[12][1] == 12
    again = classes(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "other words here in this text")])
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in again) == sorted(map(str, [(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True)]))
    assert classes(spark, rows[:0]) == []
    assert len(classes(spark, rows[:1])) == 1


def test_deduplicated(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "other words in a text")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n int")
    out = neardup.deduplicated(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def test_rows_without_id(spark):
    """Unique ones stay, and one of each group of copies and near copies without any id."""
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:58], "x", "y"])
    rows = [(None, " ".join(words)), (None, near), (None, near), (None, "on its own here in this text"), (4, "another text with some words"), (None, "another text with some words"), (None, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "z", 3) for i, t in rows], "doc_id long, text string, _kept string, row int")
    out = neardup.deduplicated(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == 5 and sum(r["text"] in (near, " ".join(words)) for r in got) == 1 and [r["doc_id"] for r in got if r["text"] and "another" in r["text"]] == [4]


def test_rows_with_equal_ids_and_other_texts(spark):
    df = spark.createDataFrame([(1, "the first text with five words"), (3, "the first text with five words"), (3, "quite another text of six words"), (3, "quite another text of six words")], "doc_id long, text string")
    got = neardup.deduplicated(df).collect()
    assert all(r["doc_id"] in (1, 3) for r in got) and len(got) <= 2 and (1, "the first text with five words") in [tuple(r) for r in got]


def test_a_very_long_text(spark):
    long_ = " ".join(f"v{k}" for k in range(300_000))
    got = {r["doc_id"]: r["component_id"] for r in classes(spark, [(7, long_), (3, long_ + " and a tail"), (5, long_[: len(long_) // 2])])}
    assert got == {7: 3, 3: 3, 5: 5}


def test_what_blocks_read_grows_with_the_rows(spark):
    """A bucket of documents that are all strays: rows with all their copies by the number of documents, and the largest shard."""
    read = {}
    for n in (2000, 16000, 64000):
        rows = spark.range(n).selectExpr("1L as key", "id as rep", "id as component")
        dealt = neardup._dealt(rows, neardup._mixed(rows, F.lit(1)), 100, 200, larger=16)
        read[n] = dealt.count() / n
        units = dealt.groupBy("key", "i", "j").count().agg({"count": "max"}).first()[0]
        assert units <= 2.5 * max(100, min(1600, n / 16))
        assert dealt.groupBy("shard").count().count() > 0.5 * dealt.count() / max(200, units)
    assert read[2000] <= 42 and read[16000] <= 34 and read[64000] <= 82


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.7, 0.9):
        error = []
        for _ in range(30):
            shared, own = int(1000 * j), (1000 - int(1000 * j)) // 2
            x = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
            a, b = (neardup.packed(neardup.minima(np.sort(s))).view(np.uint64) for s in (x[: shared + own], np.concatenate((x[:shared], x[shared + own :]))))
            off = sum(int(np.bitwise_count((y | y >> np.uint64(1) | y >> np.uint64(2) | y >> np.uint64(3)) & neardup._MARK)) for y in a ^ b)
            c = 2.0**-neardup.BITS
            error.append(((1 - off / neardup.PLACES) - c) / (1 - c) - shared / len(x))
        assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.08
