"""Each stage of the pipeline against a plain version on its own input, and the whole."""

import public_tokenizers
import pytest

import corpus_pipeline
from lumenvec.llm import langid, mixing, packing, pii

from .test_mixing import brute_targets
from .test_neardup import brute

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "packing"]


def test_language(spark, sf, docs):
    out = STAGE["language"](spark, docs, sf)
    model = langid.fit(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect() if not model.predict(r["text"])[2]}


def test_near_duplicates(spark, sf, docs):
    out = STAGE["near_duplicates"](spark, docs, sf)
    want = {i for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in docs.collect()], percent=80).items() if i == c}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want


def test_near_duplicates_from_80_percent(spark, sf):
    words = [f"w{k}" for k in range(104)]
    near = " ".join(words[:94] + [f"z{k}" for k in range(11)])  # 90 shingles of 100 and 101 in common: 0.81
    apart = " ".join(words[:92] + [f"y{k}" for k in range(13)])  # 88 in common: 0.78 with the first
    texts = [(1, " ".join(words)), (2, near), (3, apart)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, (_, c) in brute(texts, percent=80).items() if i == c}
    assert want == {1, 3} and {i for i, (_, c) in brute(texts).items() if i == c} == {1, 2, 3}
    assert {r["doc_id"] for r in STAGE["near_duplicates"](spark, df, sf).collect()} == want


def test_personal_data(spark, sf, docs):
    out = STAGE["personal_data"](spark, docs, sf)
    assert out.schema == docs.schema
    got, forest = {r["doc_id"]: r for r in out.collect()}, pii.trained()
    for r in docs.collect():
        base, added = pii.find(r["text"], forest)
        own = got[r["doc_id"]]
        assert own["n_chars"] == len(own["text"]) and pii.base_spans(own["text"]) == []
        assert (own["text"] == r["text"]) == (not base and not added)


def test_mixture(spark, sf, docs):
    out = STAGE["mixture"](spark, docs, sf)
    assert out.columns == docs.columns
    sizes, took, copies = {}, {}, {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in out.collect():
        took[r["source"]] = took.get(r["source"], 0) + len(r["text"].split())
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 2
    for s, goal in brute_targets(sizes).items():
        assert abs(took.get(s, 0) - goal) <= max(60, 0.1 * goal)


def test_packing(spark, sf, docs):
    out = STAGE["packing"](spark, docs, sf)
    want = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(out.select(key).collect()) == sorted(want.select(key).collect())


def test_run_is_its_stages(spark, sf, docs):
    got = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect()
    d = docs
    for name in ("language", "near_duplicates", "personal_data", "mixture", "packing"):
        d = STAGE[name](spark, d, sf)
    assert sorted(got) == sorted(d.select("doc_id", "piece", "ids_crc32").collect())


def test_messy_tables(spark, sf):
    rows = [(1, None, "en", "a", 0), (2, "", "de", None, 0), (None, "the cat and the dog", "en", "a", 19), (3, "the cat and the dog", None, "b", 19), (3, "the cat and the dog", None, "b", 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (df, df.limit(0)):
        d = some
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, sf)
        d.collect()
    assert mixing.mixed(df).columns == df.columns


def test_clashing_names_are_carried_along(spark, sf):
    names = ["row", "doc", "copies", "_id", "_found", "_kept", "size", "component", "rejected", "rank", "ID", "h"]
    df = spark.createDataFrame([(k, f"the words of text {k} and no other, mail a{k}@b.org " + " ".join(f"w{k}x{j}" for j in range(30)), "en", "a", 9, *[f"{c}{k}" for c in names]) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    d = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == df.columns
    rows = d.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names) and all("[EMAIL]" in r["text"] for r in rows)
