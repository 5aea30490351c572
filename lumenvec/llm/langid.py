"""Language identification by compression.

For each language a bounded sample of labelled texts becomes a raw-content Zstandard dictionary. A text, reduced to its
lower-cased letters, is cut into blocks; each block is compressed with every dictionary, and the language whose
dictionary yields the fewest bytes over all blocks is predicted. The margin of the best over the second, relative to
the second, gives the score. Where the margin is narrow the text is compressed a second time, at a stronger level and behind a filler
that ends every dictionary (Zstandard stores very short inputs as they are, behind a long match it doesn't), and these sizes decide. Where they are
narrow too, the text is rejected.

Fitting counts all rows by language, and reads the text of about docs_per_lang rows (a share by the hash of the id) of each of the max_langs
languages with the most rows: that bound is the documented sample. Of a row, doc_pieces pieces spread evenly over its whole text, doc_chars code points
together, are taken, and a dictionary of dict_bytes has an equal share of each of its rows, as far as they reach. Prediction reads
whole texts, nothing but the text, and needs no shuffle.

Defined cases: a null text, an empty one, or one without a letter, is `und` with score 0 and rejected; a very long text is compressed block by
block; of languages that remain equal the one with more training rows wins, then the first by name (and the text is rejected); repeated rows get equal
predictions; a null id isn't held out, and isn't learned from; an empty training set predicts `und` for all; an empty table gives no rows; columns other than
the id, the text and in fitting the language are carried or left out, never read, so their names may be any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, spark_struct, unused

UNDETERMINED = "und"
FIELDS = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
_letters = re.compile(r"[^\W\d_]+").findall


def reduced(text: str) -> bytes:
    return " ".join(_letters(text.lower())).encode()


#: Ends every dictionary of a second look; digits, which no reduced text has.
_FILLER = b"".join(b"%d" % (k * k * 7919) for k in range(64))


def spread(text: bytes, n: int, pieces: int = 4) -> bytes:
    """text, or n bytes of it in pieces spread evenly."""
    if len(text) <= n:
        return text
    each = n // pieces
    return b" ".join(text[(len(text) - each) * k // (pieces - 1) :][:each] for k in range(pieces))


def shared_out(texts: list[bytes], n: int) -> bytes:
    """About n bytes of all texts, an equal share of each as far as it reaches."""
    left, share = n, n
    for k, size in enumerate(sorted(map(len, texts))):
        if size > (share := left // (len(texts) - k)):
            break
        left -= size
    return b" ".join(spread(t, share) for t in texts)[:n]


@dataclass
class Model:
    """Small enough to travel with each task: one dictionary of at most dict_bytes a language."""

    dictionaries: dict[str, bytes]  # in the order in which ties are decided
    block: int = 1024
    level: int = 5
    fine_level: int = 12
    full_margin: float = 0.08  # a relative margin from which the score is 1
    min_margin: float = 0.004

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("compressors", "fine")}

    def _compressors(self, level: int, end: bytes) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang, content in self.dictionaries.items():
            d = zstandard.ZstdCompressionDict(content + end, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            out.append((lang, zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
        return out

    @cached_property
    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        return self._compressors(self.level, b"")

    @cached_property
    def fine(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        return self._compressors(self.fine_level, _FILLER)

    def sizes(self, text: str, fine: bool = False) -> list[tuple[int, str]]:
        data, head = reduced(text), _FILLER if fine else b""
        blocks = [head + data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [(sum(len(c.compress(b)) for b in blocks), lang) for lang, c in (self.fine if fine else self.compressors)]

    def _best(self, found: list[tuple[int, str]]) -> tuple[str, float]:
        """The language with the fewest bytes, the first of equals, and its margin."""
        best, lang = min(found, key=lambda x: x[0])
        second = min(size for size, other in found if other != lang)
        return lang, (second - best) / second

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.dictionaries or not any(c.isalpha() for w in _letters(text) for c in w):  # \w also has digits like a superscript two
            return UNDETERMINED, 0.0, True
        if len(self.dictionaries) == 1:
            return next(iter(self.dictionaries)), 1.0, False
        lang, margin = self._best(self.sizes(text))
        if margin < self.min_margin:
            lang, margin = self._best(self.sizes(text, fine=True))
        return lang, min(1.0, margin / self.full_margin), margin < self.min_margin


def held_out(id_col: Column) -> Column:
    """Every fifth row by checksum of its id; a null id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 300, max_langs: int = 256, doc_chars: int = 2000, doc_pieces: int = 8, dict_bytes: int = 1 << 17, **options) -> Model:
    """Learn from rows with a language that are not held out."""
    i, lang = F.col(id_col), F.col(lang_col)
    rows = docs.where(lang.isNotNull() & i.isNotNull() & ~held_out(i) & F.col(text_col).isNotNull())
    counts = rows.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_langs)
    total = {r["lang"]: r["n"] for r in counts.collect()}
    if not total:
        return Model({}, **options)
    # a share of each language by the hash of the id: no ranking, which would gather a language in one task
    part = F.create_map(*[F.lit(x) for name, n in total.items() for x in (name, min(1 << 32, (docs_per_lang << 32) // n))])
    text, each = F.col(text_col), doc_chars // doc_pieces
    at = lambda k: F.floor((F.length(text) - each) * k / (doc_pieces - 1)).cast("int") + 1
    some = F.when(F.length(text) <= doc_chars, text).otherwise(F.concat_ws(" ", *[F.substring(text, at(F.lit(k)), F.lit(each)) for k in range(doc_pieces)]))
    sample = rows.select(lang.alias("lang"), F.xxhash64(i.cast("string")).alias("h"), some.alias("t")).where(F.pmod("h", F.lit(1 << 32)) < part[F.col("lang")])
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.collect():
        texts.setdefault(r["lang"], []).append((r["h"], r["t"]))
    order = sorted(texts, key=lambda x: (-total[x], x))
    return Model({x: shared_out([reduced(t) for _, t in sorted(texts[x])], dict_bytes) for x in order}, **options)


def predictions(model: Model, text: Column) -> Column:
    """A struct with FIELDS for each text."""

    @F.arrow_udf(spark_struct(FIELDS))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield arrow_rows(FIELDS, [model.predict(t.as_py()) for t in texts])

    return predict(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fit on docs, then id_col, held_out and FIELDS for each of its rows."""
    model = fit(docs, id_col, text_col, lang_col, **options)
    held, found = unused(docs.select(id_col), "held_out", "_found")
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias(held), predictions(model, F.col(text_col)).alias(found)).select(id_col, held, f"{found}.*")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is not rejected, with the columns of docs."""
    (found,) = unused(docs, "_found")
    return docs.withColumn(found, predictions(model, F.col(text_col))).where(~F.col(f"{found}.rejected")).drop(found)
