import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenvec.llm import license as lic

FAMILY = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}


def scanned(spark, texts):
    df = spark.createDataFrame([(k, t, "x", 2) for k, t in enumerate(texts)], "doc_id long, text string, families string, score int")
    return {r["doc_id"]: r for r in lic.scan(df).collect()}


def test_held_out_notices(spark):
    model, threshold = lic.trained(spark)
    made = [x for x in lic._made(99) if x[2]]
    windows = spark.createDataFrame([(t, k) for t, k, _ in made], "t string, k int").select("k", F.inline(lic.candidates(F.col("t"))))
    got = model.transform(lic.featured(windows)).select("k", "prediction").collect()
    assert sum(r["k"] == r["prediction"] for r in got) >= 0.93 * len(got) and 0.3 <= threshold <= 0.95


def words_of(text):
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def brute(model, threshold, text):
    """Families and the number of notices, window by window."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.linalg import Vectors

    tf, shown = HashingTF(numFeatures=lic.DIMENSIONS), []
    for line, part in enumerate((text or "").split("\n")):
        words = words_of(part)
        for at, w in enumerate(words):
            if not (re.search("licen[sc]|copyright|^spdx|redistribut|permission|warrant", w) or " ".join(words[at : at + 2]) in ("public domain", "general public", "creative commons")):
                continue
            own = words[max(0, at - 12) : at + 13]
            terms = {" ".join(own[k : k + n]) for n in (1, 2, 3) for k in range(len(own) - n + 1)}
            p = model.predictProbability(Vectors.sparse(lic.DIMENSIONS, {tf.indexOf(t): 1.0 for t in terms})).toArray()
            k = int(p.argmax())
            pairs = set(zip(own, own[1:]))
            if k and p[k] >= threshold:
                family = list(lic.TEMPLATES)[k - 1]
                for t in lic.TEMPLATES[family]:
                    theirs = set(zip(words_of(t), words_of(t)[1:]))
                    if len(theirs & pairs) >= max(2, 0.5 * min(len(theirs), 12)):
                        shown.append((family, line, at))
                        break
    shown.sort()
    n = sum(i == 0 or x[:2] != shown[i - 1][:2] or x[2] - shown[i - 1][2] > 24 for i, x in enumerate(shown))
    return ",".join(sorted({f for f, _, _ in shown})), n


def test_against_brute_force(spark):
    model, threshold = lic.trained(spark)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(8)
    for t in [t for ts in lic.TEMPLATES.values() for t in ts] + list(lic.ORDINARY):
        words = t.split()
        at = rng.randrange(len(words))
        texts += [t, " ".join(words[:at] + ["xyzzy"] + words[at:]), " ".join(words[at:]), f"{t} {rng.choice(lic.ORDINARY)}\n{t.upper()}"]
    got = scanned(spark, texts)
    want = [brute(model, threshold, t) for t in texts]
    assert [(got[k]["families"], got[k]["n_licenses"]) for k in range(len(texts))] == want
    assert len({f for f, _ in want}) >= 9


def test_very_long_words_lines_and_texts(spark):
    """A megabyte each; a pattern that is tried again from every place would take hours."""
    notice = "Released under the MIT License."
    texts = ["copyright " + "the " * 30 + "x" * 10**6, "copyright " + "x" * 10**6 + " copyright", notice + " " + "a;b=" * 250_000, "license " * 10_000 + "\n" + notice, ("word " * 200_000) + notice, "copyright\n" * 20_000 + notice]
    began = time.time()
    got = scanned(spark, texts)
    assert time.time() - began < 120
    assert [got[k]["families"] for k in range(6)] == ["", "", "mit", "mit", "mit", "mit"]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["families"] for r in lic.scan(docs).collect()}
    assert len(got) == docs.count()
    n = 0
    for r in docs.select("doc_id", "text").collect():
        want = ",".join(sorted({f for notice, f in FAMILY.items() if notice in r["text"]}))
        n += bool(want)
        assert got[r["doc_id"]] == want
    assert n > 5


def test_forms(spark):
    rng = random.Random(1)
    prose = " ".join(rng.choice(("the", "ander", "ing", "ofthe", "ration")) for _ in range(4000))
    texts = [f"{prose}\n{n}\n{prose}" for n in FAMILY] + [f"{prose} {n} {prose}" for n in FAMILY] + [n.upper() for n in FAMILY]
    got = scanned(spark, texts)
    for k in range(len(texts)):
        assert got[k]["families"] == list(FAMILY.values())[k % 4], texts[k][:80]


@pytest.mark.parametrize("text", [None, "", "no cue here", "A fishing license is required.", "copyright", "license " * 3000])
def test_no_notice(spark, text):
    got = scanned(spark, [text])[0]
    assert (got["n_licenses"], got["families"], got["score"]) == (0, "", 0.0)


def test_tables(spark):
    notice = next(iter(FAMILY))
    df = spark.createDataFrame([(1, notice, 5, "x"), (1, notice, 5, "x"), (None, notice, 5, "x")], "doc_id long, text string, row int, words string")
    assert sorted(str((r["doc_id"], r["families"])) for r in lic.scan(df).collect()) == ["(1, 'apache')", "(1, 'apache')", "(None, 'apache')"]
    assert lic.scan(df.limit(0)).collect() == []
    text = lic.scan(df)._jdf.queryExecution().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))


def test_notices_after_other_cues_in_one_long_line(spark):
    prose = " ".join(("the", "ander", "ing", "ofthe", "ration") * 60)
    owner = "Copyright 2020 The Foo Authors and contributors. All rights reserved."
    texts = [f"{prose} {owner} {n} {prose}" for n in FAMILY] + [f"{prose} {owner[:-21]} {n} {prose}" for n in FAMILY]
    got = scanned(spark, texts + [f"{prose} Released under the MIT License. {prose} Released under the MIT License. {prose}"])
    for k in range(len(texts)):
        assert (got[k]["families"], got[k]["n_licenses"]) == (list(FAMILY.values())[k % 4], 1), texts[k][len(prose) : -len(prose)]
    assert (got[8]["families"], got[8]["n_licenses"]) == ("mit", 2)


def test_one_row_for_a_document_of_several_candidates(spark):
    df = spark.createDataFrame([(1, "\n".join(FAMILY)), (1, "\n".join(FAMILY))], "doc_id long, text string")
    got = lic.scan(df).collect()
    assert [(r["n_candidates"], r["n_licenses"], r["families"]) for r in got] == [(7, 4, ",".join(sorted(FAMILY.values())))] * 2  # seven cues
