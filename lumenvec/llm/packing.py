"""Best-fit packing of tokenized documents into sequences of one capacity.

Every document becomes its token ids and an end id; only documents longer than the capacity are cut, into pieces of the
capacity and a last shorter one. Pieces are dealt to shards of about shard_rows by a hash, which bounds what one task
holds whatever the input. Within a shard, packing works on the counts of each length: from the longest down, a gap is
filled exactly by one, two or three lengths whose sum is the gap, found in an index of single, pair and triple sums and
consumed as often as the counts allow; what finds no exact complement goes to the open sequence that it fits best.

A tokenizer that drops white space and never joins text across it or across the bounds of its words has as ids of a text
those of its words in turn, and words seen before come from a bounded cache. Texts in Latin letters are split into those words here; others
at spaces only, which is as exact and leaves the rest to the tokenizer. Whether a tokenizer is of that kind is read from its file; any other gets whole texts.

Defined cases: a null or empty text is one piece with the end id only; a very long text is cut into pieces; rows with equal or null ids are packed as
separate documents; of pieces with equal lengths the one with the smaller id is placed first; an empty table gives no rows; columns other than the id and the
text are not read, so their names may be any.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

CACHE_ENTRIES, CACHE_CHARS = 700_000, 40
_tokenizers: dict[str, WordTokenizer] = {}
#: Texts of these characters are split here as the tokenizer splits them; lower-casing and normalising change each of them alone.
_plain = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*").fullmatch
_LETTERS, _NUMBERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_words = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+").findall


#: The settings with which the words below are the tokenizer's own.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.by_words = {k: said.get(k) for k in _BY_WORDS} == _BY_WORDS
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    @staticmethod
    def of(path: str) -> WordTokenizer:
        """One for each worker process."""
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        return _tokenizers[path]

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self.one(text)
        plain = _plain(text) and "<|" not in text  # which may begin a special token
        words = _words(text.lower()) if plain else list(map(_chunk, text.replace("\n", " ").split(" ")))
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known = self.known
        try:
            return b"".join(map(known.get, words))
        except TypeError:  # None for words not seen before
            new = list(set(itertools.filterfalse(known.__contains__, words)))
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(new):
                data, at = ids.tobytes(), (4 * at).tolist()
                known.update(zip(new, map(data.__getitem__, map(slice, [0, *at], at)), strict=False))
            else:
                known.update((w, self.one(w)) for w in new)
        else:
            known.update((w, self.one(w[1:])) for w in new)
        out = b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out


def _chunk(text: str) -> str:
    """The key of a chunk that the tokenizer has yet to split."""
    return "\n" + text


_PIECE = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece; with_ids adds the ids themselves (binary, little-endian unsigned 32-bit)."""
    spark_kind = T.StructType([T.StructField(k, v) for k, v in _PIECE.items()] + [T.StructField("ids", T.BinaryType())] * with_ids)
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids))
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf(T.ArrayType(spark_kind))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = WordTokenizer.of(tokenizer).encode
        for texts in batches:
            rows = []
            for t in texts:
                ids = encode(t.as_py() or "") + end
                row = []
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append({"piece": n, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} | ({"ids": part} if with_ids else {}))
                rows.append(row)
            yield pa.array(rows, kind)

    return docs.select(F.col(id_col), F.explode(cut(F.col(text_col))).alias("_p")).select(id_col, "_p.*")


def complements(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Sequences to make of so many pieces of each length (its place in counts; the last is the capacity): the lengths in one sequence, and how many such sequences."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64)
    out: list[tuple[tuple[int, ...], int]] = []
    some = left > 0
    pairs, triples = np.zeros(capacity + 1, bool), np.zeros(capacity + 1, bool)  # which sums of two and three lengths there may be; kept too large, made anew when they mislead

    def index_sums() -> None:
        for sums, of in ((pairs, some), (triples, pairs)):
            sums[:] = False
            for x in np.flatnonzero(some):
                if x:
                    sums[x:] |= of[: capacity + 1 - x]

    def pair(gap: int, most: int) -> tuple[int, int] | None:
        """Two lengths, none above most, that sum to gap: the largest first."""
        x = np.arange((gap + 1) // 2, min(gap - 1, most) + 1)
        x = x[some[x] & some[gap - x]]
        for a in x[::-1]:
            if 2 * a != gap or left[a] > 1:
                return int(a), int(gap - a)
        return None

    def fill(gap: int) -> tuple[int, ...] | None:
        if some[gap]:
            return (gap,)
        if pairs[gap] and (found := pair(gap, gap)):
            return found
        if not triples[gap]:
            return None
        y = np.arange(1, gap - 1)
        y = y[some[y] & pairs[gap - y]]
        missed = 0
        for a in y[::-1]:
            if 3 * a < gap:
                break  # the largest of three is a third at least
            left[a] -= 1  # the other two are found among the rest
            some[a] = left[a] > 0
            found = pair(int(gap - a), int(a))
            left[a] += 1
            some[a] = True
            if found:
                return (int(a), *found)
            missed += 1
            if missed == 32:
                index_sums()
                if not triples[gap]:
                    return None
        return None

    def consume(lengths: tuple[int, ...]) -> bool:
        often = min(int(left[x]) // lengths.count(x) for x in lengths)
        for x in lengths:
            left[x] -= often
            some[x] = left[x] > 0
        if often:
            out.append((lengths, often))
        return often > 0

    index_sums()
    consume((capacity,))
    for a in range(capacity - 1, 0, -1):
        while left[a] > 0:
            left[a] -= 1  # the one whose gap is to be filled
            some[a] = left[a] > 0
            found = fill(capacity - a)
            left[a] += 1
            some[a] = True
            if not found or not consume((a, *found)):
                break
    # best fit: sequences that are open, by their gap
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for a in np.flatnonzero(left)[::-1].tolist():
        n = int(left[a])
        while n:
            fit = min((g for g in gaps if g >= a), default=None)
            if fit is None:
                each = min(n, capacity // a)
                gaps.setdefault(capacity - each * a, []).append(((a,) * each, n // each))
                n %= each
                continue
            lengths, often = gaps[fit].pop()
            each = min(n, fit // a)
            m = min(often, n // each)
            gaps.setdefault(fit - each * a, []).append((lengths + (a,) * each, m))
            if often > m:
                gaps[fit].append((lengths, often - m))
            if not gaps[fit]:
                del gaps[fit]
            n -= m * each
    return out + [x for found in gaps.values() for x in found]


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its sequence, from 0, and its offset in it."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    at = np.concatenate(([0], np.cumsum(counts)[:-1]))
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for found, often in complements(counts):
        start = 0
        for x in found:
            rows = order[at[x] : at[x] + often]
            at[x] += often
            sequence[rows] = made + np.arange(often)
            offset[rows] = start
            start += x
        made += often
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 20_000, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    cut = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    shards = max(1, -(-cut.count() // shard_rows))
    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards)))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in (id_col, "piece", "length", "ids_crc32")])  # equal whenever it is run again
        sequence, offset = place(t["length"].to_numpy(), capacity)
        sequence += t["_shard"][0].as_py() << 32
        return t.drop_columns(["_shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_shard").applyInArrow(one, schema)
