import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenvec.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, sequence_id string, piece string"  # extra columns with clashing names


@pytest.fixture(scope="module")
def raw():
    return Tokenizer.from_file(PATH)


def ids_of(raw, text):
    return np.array([*raw.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text("aé'sSt,. \n\t<|endoftext|>0²µÿ ́İΣ", max_size=60))
def test_ids_are_the_tokenizers(text):
    whole = Tokenizer.from_file(PATH) if not hasattr(test_ids_are_the_tokenizers, "t") else test_ids_are_the_tokenizers.t
    test_ids_are_the_tokenizers.t = whole
    text = text.encode("utf-8", "ignore").decode()
    assert packing.WordTokenizer.of(PATH).encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_tokenizers_get_whole_texts(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(said, f)
    t, whole = packing.WordTokenizer(path), Tokenizer.from_file(path)
    assert not t.by_words and packing.WordTokenizer(PATH).by_words
    for text in ("it's 12 words, don't", "é x\n\ny", ""):
        assert t.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_tokens_and_cache(raw):
    t = packing.WordTokenizer(PATH)
    for text in ("a <|endoftext|> b", "x<|startoftext|>y don't", "word " * 50, "n" * 5000):
        for _ in range(2):
            assert t.encode(text) == ids_of(raw, text)[:-1].tobytes()
    t.known = dict.fromkeys(map(str, range(packing.CACHE_ENTRIES + 1)), b"")
    assert t.encode("some words 7") == ids_of(raw, "some words 7")[:-1].tobytes()


def test_place_fills_gapless_and_tight():
    rng = random.Random(1)
    for lengths in ([5], [10] * 7, [7, 3, 6, 4, 5, 5, 2, 8, 1, 9], [rng.randint(1, 100) for _ in range(3000)], [rng.choice((33, 34, 50, 67, 99)) for _ in range(500)]):
        cap = max(10, max(lengths))
        sequence, offset = packing.place(np.array(lengths), cap)
        spans = {}
        for n, s, o in zip(lengths, sequence.tolist(), offset.tolist(), strict=True):
            spans.setdefault(s, []).append((o, n))
        for found in spans.values():
            at = 0
            for o, n in sorted(found):
                assert o == at
                at += n
            assert at <= cap
        assert len(spans) <= -(-sum(lengths) // cap) * 1.35 + 1
    assert len(set(packing.place(np.array([7, 3, 6, 4, 5, 5, 2, 8, 1, 9]), 10)[0])) == 5  # all gaps have exact complements
    assert len(set(packing.place(np.array([4, 3, 2, 1] * 9), 10)[0])) == 9


def test_complements_use_triples_and_respect_counts():
    counts = np.zeros(101, int)
    counts[[40, 30, 20, 10]] = 3  # 40 + 30 + 20 + 10
    assert sum(n for _, n in packing.complements(counts)) == 3
    counts[:] = 0
    counts[50] = 3
    assert sorted(packing.complements(counts)) == [((50,), 1), ((50, 50), 1)]


def test_pack(spark, raw):
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "word, " * 3000), (None, "no id"), (5, "x" * 20000)]
    df = spark.createDataFrame([(i, t, "s", "p") for i, t in rows], SCHEMA)
    got = packing.pack(df, PATH, capacity=64).collect()
    want = []
    for i, t in rows:
        ids = ids_of(raw, t)
        want += [(i, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted(map(str, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got))) == sorted(map(str, want))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for o, n in sorted(found):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(r["length"] for r in got) // 64) + 2
    assert packing.pack(df.limit(0), PATH).collect() == []
    shards = packing.pack(df, PATH, capacity=64, shard_rows=40).collect()
    assert len(shards) == len(got) and len({r["sequence_id"] >> 32 for r in shards}) > 1
    assert packing.pieces(df.where("doc_id = 3"), PATH, with_ids=True).first()["ids"] == ids_of(raw, "one two three").tobytes()


def test_query(spark, sf):
    from lumenvec.llm.queries import QUERIES

    got = QUERIES["op1_packing"](spark, sf).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    used = {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1
