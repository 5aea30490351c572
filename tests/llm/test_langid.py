import pickle
import re
import zlib

import pytest
import zstandard

from lumenvec.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def model():
    return langid.Model({"en": b"the and of to in that is was for with " * 40, "de": b"der die und von mit das ist ein nicht auf " * 40})


def plain(dictionaries, text):
    """Best language and margin, from every dictionary anew."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und", True
    data = " ".join(words).encode()
    for level, head in ((5, b""), (12, langid._FILLER)):
        size = {}
        for lang, content in dictionaries.items():
            c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content + head, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            size[lang] = sum(len(c.compress(head + data[at : at + 1024])) for at in range(0, len(data), 1024))
        (best, _, lang), (second, _, _) = sorted((n, k, lang) for k, (lang, n) in enumerate(size.items()))[:2]
        if second - best >= 0.004 * second:
            return lang, False
    return lang, True


def test_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = langid.fit(docs)
    texts = [r["text"] for r in docs.collect()] + ["Edstou reinan ed for.", "This.", "Re.", "é", "x 1"]
    assert all(m.predict(t)[::2] == plain(m.dictionaries, t or "") for t in texts)


def test_ties():
    m = langid.Model({"b": b"alpha beta gamma " * 9, "a": b"alpha beta gamma " * 9})
    assert m.predict("alpha beta gamma") == ("b", 0.0, True)  # the first: the one with more rows


def test_the_sample_is_spread_over_texts_and_rows():
    assert langid.spread(bytes(range(100)), 8) == b" ".join((b"\0\1", bytes((32, 33)), bytes((65, 66)), bytes((98, 99))))
    out = langid.shared_out([b"a" * 1000, b"b" * 10, b"c" * 1000], 210)
    assert abs(out.count(b"a") - 97) <= 4 and out.count(b"b") == 10 and abs(out.count(b"c") - 97) <= 7


def test_a_long_text_is_sampled_over_its_whole(spark):
    df = spark.createDataFrame([(k, "first " * 2000 + "middle " * 2000 + "last " * 2000, "en") for k in range(10)], "doc_id long, text string, lang string")
    words = langid.fit(df).dictionaries["en"]
    assert b"first" in words and b"middle" in words and b"last" in words


def test_languages_are_bounded(spark):
    df = spark.range(511).selectExpr("id as doc_id", "'the cat' as text", "concat('l', cast(log2(id + 1) as int)) as lang")
    assert set(langid.fit(df, max_langs=3).dictionaries) == {"l8", "l7", "l6"}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "the and of to in that is was for with", "en", "x", True)], "held_out long, text string, lang string, _found string, rejected boolean")
    out = langid.keep_identified(df, model())
    assert out.columns == df.columns and out.collect() == df.collect()
    assert langid.identify(df, id_col="held_out").columns == ["held_out", "_held_out", "lang_pred", "score", "rejected"]


def test_cases():
    m = model()
    assert m.predict("the cat is with that")[0] == "en" and m.predict("DER HUND!! UND DIE VON!! MIT DAS IST EIN NICHT!!")[0] == "de"
    assert m.predict("DER HUND!! IST!! NICHT!!")[2]  # as many bytes with either dictionary
    for text in (None, "", "123 ... \n", "²³"):
        assert m.predict(text) == ("und", 0.0, True)
    assert m.predict("zzz qqq xxx")[2]  # nothing tells
    assert m.predict("the und " * 20000)[0] in ("en", "de")
    assert langid.Model({}).predict("the") == ("und", 0.0, True) and langid.Model({"en": b"the"}).predict("x")[:2] == ("en", 1.0)
    assert pickle.loads(pickle.dumps(m)).predict("the cat is with that") == m.predict("the cat is with that")


def test_tables(spark):
    rows = [(k, "the cat and the dog of the house in that time", "en") for k in range(40)] + [(100 + k, "der hund und die katze von dem haus mit der zeit", "de") for k in range(40)]
    rows += [(None, "the cat", "en"), (500, None, "en"), (501, "der hund und die katze", None)]
    df = spark.createDataFrame([(i, t, s, 0.5, "q") for i, t, s in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert got[500]["lang_pred"] == "und" and got[501]["lang_pred"] == "de" and not got[None]["held_out"]
    kept = langid.keep_identified(df, langid.fit(df))
    assert kept.columns == df.columns and kept.where("doc_id = 500").count() == 0 and kept.where("doc_id = 501").count() == 1
    assert langid.identify(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(df.where("lang is null")).collect()} == {"und"}


def test_prediction_uses_the_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = langid.fit(docs)
    a = docs.select("text", langid.predictions(m, docs["text"]).alias("p")).collect()
    assert all(m.predict(r["text"])[0] == r["p"]["lang_pred"] for r in a)


@pytest.mark.parametrize("n", [1, 10])
def test_the_sample_is_bounded(spark, n):
    df = spark.range(2000).selectExpr("id as doc_id", "'the cat and the dog' as text", "'en' as lang")
    assert len(langid.fit(df, docs_per_lang=n).dictionaries.get("en", b"")) <= 20 * (4 * n + 8)
