import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenvec.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    out["n_dup_lines"], out["dup_line_chars"] = len(again), sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in again)
    for n in quality.MAX_COVERED:
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        count = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(n)}
        out[f"covered_{n}"] = sum(len(words[k]) for k in hit)
        if n == 8:
            out["n_repeat_words"] = len(hit)
    out["base_failed"] = out["n_words"] < 20 or 100 * out["n_repeat_words"] > 30 * out["n_words"]
    bad = any(100 * out[f"covered_{n}"] > most * out["word_chars"] for n, most in quality.MAX_COVERED.items()) or 100 * out["dup_line_chars"] > 30 * out["word_chars"]
    out["kept"] = not out["base_failed"] and not bad
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab #\n\té\x0b", max_size=300) | st.lists(st.sampled_from(["a", "b", "a b", "c d e f g h", "\n", "#|"]), max_size=60).map(" ".join))
def test_equals_brute_force(text):
    assert dict(zip(quality.FIELDS, quality.measure_text(text), strict=True)) == brute(text)


def test_documents(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect():
        assert dict(zip(quality.FIELDS, quality.measure_text(r["text"]), strict=True)) == brute(r["text"])


def test_collisions_change_nothing(monkeypatch):
    text = " ".join(f"w{k % 17}" for k in range(90)) + " " + " ".join(f"v{k}" for k in range(90))
    want = brute(text)
    monkeypatch.setattr(quality, "_mixed", lambda ids: np.zeros(len(ids), np.uint64))
    assert dict(zip(quality.FIELDS, quality.measure_text(text), strict=True)) == want


def test_table(spark):
    long = " ".join(f"w{k}" for k in range(60000))
    rows = [(1, None), (2, ""), (3, "a b " * 30), (4, long), (4, long), (None, " ".join(f"x{k}" for k in range(30)))]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, kept string, n_words int")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert got[4]["kept"] and got[None]["kept"] and not got[3]["kept"] and got[1]["base_failed"] and got[1]["n_words"] == 0 and got[2]["n_words"] == 0
    assert quality.judge(df).count() == 6 and quality.judge(df.limit(0)).collect() == []
