"""Quality rules: how much of a text lies in repeated n-grams and lines.

Words are maximal runs without ASCII white space. In each text, windows of n words get a rolling hash (numpy, modulo
2**64); windows with equal hashes are compared word by word, so a hash collision changes nothing. The coverage of n is
the share of word characters in windows that occur twice or more, the first occurrence included.

Defined cases: a null or empty text has no words and fails; a very long text is measured whole, in memory of a few arrays of one number a word, and its time grows with words times their logarithm;
windows whose hashes tie are compared themselves; repeated rows, and rows with equal or null ids, are judged alike, a row each; an empty table gives no rows; columns other than the id
and the text are not read, so their names may be any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_rows, spark_struct

#: A text is rejected if over so many per cent of its word characters are in repeated windows of n words.
MAX_COVERED = {5: 45, 6: 42, 7: 40, 8: 36, 9: 34, 10: 32}
#: The same for the characters of repeated lines, first occurrences not counted.
MAX_LINE_CHARS = 30
BASE_N, BASE_MIN_WORDS, BASE_MAX_REPEAT = 8, 20, 30

FIELDS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "dup_line_chars": "bigint", **{f"covered_{n}": "bigint" for n in MAX_COVERED}, "base_failed": "boolean", "kept": "boolean",
}

_words = re.compile(WORD).findall
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_P, 4096), _powers(_INVERSE, 4096)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def repeated(ids: np.ndarray, sums: np.ndarray, down: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether it is in a window of n words that occurs twice or more."""
    m = len(ids) - n + 1
    covered = np.zeros(len(ids), bool)
    if m < 2:
        return covered
    h = (sums[n:] - sums[:m]) * down[:m]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return covered
    a, b = order[:-1][same], order[1:][same]
    equal = np.ones(len(a), bool)
    for k in range(n):
        equal &= ids[a + k] == ids[b + k]
    if equal.all():
        hit = np.zeros(m + 1, bool)
        hit[a] = hit[b] = True
        starts = hit[:m]
    else:  # hashes collide: count the windows themselves
        seen: dict[bytes, list[int]] = {}
        for i in range(m):
            seen.setdefault(ids[i : i + n].tobytes(), []).append(i)
        starts = np.zeros(m, bool)
        for found in seen.values():
            starts[found] = len(found) > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure_text(text: str | None) -> tuple:
    """The values of FIELDS, in their order."""
    global _up, _down
    text = text or ""
    words = _words(text)
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    sizes = np.fromiter(map(len, index), np.int64, len(index))[ids] if words else ids
    n_words, chars = len(words), int(sizes.sum())
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, _words(line)))
        elif _words(line):
            seen.add(line)
    if n_words > len(_up):
        _up, _down = _powers(_P, 2 * n_words), _powers(_INVERSE, 2 * n_words)
    sums = np.zeros(n_words + 1, np.uint64)
    np.cumsum(_mixed(ids) * _up[:n_words], out=sums[1:])
    covered = {n: repeated(ids, sums, _down, n) for n in MAX_COVERED}
    repeats = int(covered[BASE_N].sum())
    by_n = [int(sizes[covered[n]].sum()) for n in MAX_COVERED]
    failed = n_words < BASE_MIN_WORDS or 100 * repeats > BASE_MAX_REPEAT * n_words
    bad = any(100 * c > most * chars for c, most in zip(by_n, MAX_COVERED.values(), strict=True)) or 100 * dup_chars > MAX_LINE_CHARS * chars
    symbols = sum(map(text.count, "#*$%&|<>"))
    return (n_words, chars, symbols, dup_lines, repeats, dup_chars, *by_n, failed, not failed and not bad)


@F.arrow_udf(spark_struct(FIELDS))
def _measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield arrow_rows(FIELDS, [measure_text(t.as_py()) for t in texts])


def measures(text: Column | str) -> Column:
    """A struct with FIELDS for each text. The work is row by row: no shuffle, and the memory of one batch."""
    return _measure(text)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and FIELDS for each row of docs; kept is the verdict."""
    return docs.select(F.col(id_col), measures(F.col(text_col)).alias("_m")).select(id_col, "_m.*")
