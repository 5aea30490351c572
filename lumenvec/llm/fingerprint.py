"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a weighted set: its words, each with its number of occurrences S. For each of SAMPLES and each word, two Gamma(2, 1)
values r and c and a uniform b come from one hash of the word; t = floor(ln S / r + b), and the word with the smallest
ln c - r * (t - b + 1) is sampled together with t. The sample of two texts is equal with a probability that is their generalised
Jaccard similarity, sum of least over sum of greatest weights; a fingerprint is the SAMPLES samples, five hexadecimal digits each.
The gamma values are taken from GRID quantiles, so a sample costs a hash and two array reads.

The order of documents is found on rows without texts, dealt by ranges. Texts are shuffled once, by row, and each sends its beginning to the
document before it, which alone needs it. Words, weights and samples follow in that partitioning without another shuffle: a word that a text and its
edited text hold equally often is sampled once for both. There are as many partitions as the code points ask for.

Defined cases: a null or empty text has no words; a text without words has a fingerprint of dashes, like any other such text and unlike all
others; a very long one is a row of its partition, whose words are aggregated with spilling; rows with equal ids follow each other by a hash of the text, then
by their place in the table (what a shuffle deals out is written first, so that places stay); a null id comes after all others, and such rows are dealt like others; the document after the last is the
first, so a single document follows itself; an empty table gives no rows; columns other than the id and the text are not read, so their names may be any.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_order, stable, written

SAMPLES, DIGITS, GRID = 32, 5, 512
#: Code points of own texts in a partition.
PART_CHARS = 16 << 20
_EMPTY = "-" * DIGITS


def _gamma_quantile(p: float) -> float:
    """Of Gamma(2, 1), whose distribution function is 1 - (1 + x) * exp(-x)."""
    low, high = 0.0, 64.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < p else (low, x)
    return (low + high) / 2


_R = [round(_gamma_quantile((k + 0.5) / GRID), 9) for k in range(GRID)]
_LN_C = [round(math.log(x), 9) for x in _R]


def _array(values: list[float]) -> Column:
    """A constant array. It is folded when the plan is made; as one text it costs the planner three nodes."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _bid(h: Column, ln_weight: Column, grids: dict[str, Column]) -> Column:
    """A word's bid for a sample by its hash: a long whose order is that of ln c - r * (t - b + 1), and whose last 20 bits tell word and t.

    Nothing in it can be null as Spark sees it (products for quotients, defaults for array reads), so the code made of it has few branches; with many, an executor once outgrew its memory, most likely in the JIT compiler."""
    bits = int(math.log2(GRID))
    read = lambda name, shift: F.coalesce(F.get(grids[name], F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(GRID - 1)).cast("int")), F.lit(1.0))
    b = F.shiftrightunsigned(h, 2 * bits).bitwiseAND(F.lit((1 << 24) - 1)).cast("double") * F.lit(2.0**-24)
    t = F.floor(ln_weight * read("1/r", 0) + b)
    bid = F.floor((read("ln c", bits) - read("r", 0) * (t.cast("double") - b + F.lit(1.0)) + F.lit(96.0)) * F.lit(float(1 << 34))).cast("long")
    who = F.shiftrightunsigned(h, 44).bitwiseXOR(t.cast("long") * F.lit(0x9E3B)).bitwiseAND(F.lit(0xFFFFF))
    return F.shiftleft(bid, 20).bitwiseOR(who)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints."""
    equal = [(F.substring(a, 1 + DIGITS * k, DIGITS) == F.substring(b, 1 + DIGITS * k, DIGITS)).cast("int") for k in range(SAMPLES)]
    return reduce(lambda x, y: x + y, equal) / F.lit(float(SAMPLES))


def _words(text: Column) -> Column:
    """Parts between white space, empty ones too."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " ")


def _lowest(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s0, s1, ...: the lowest bids over rows (keys, term, ln)."""
    grids = {"r": _array(_R), "1/r": _array([1 / r for r in _R]), "ln c": _array(_LN_C)}
    hashed = weighted.select(*keys, F.coalesce("ln", F.lit(0.0)).alias("ln"), *[F.xxhash64("term", F.lit(k)).alias(f"h{k}") for k in range(SAMPLES)])  # columns: a bid reads its hash several times
    return hashed.groupBy(*keys).agg(*[F.min(_bid(F.col(f"h{k}"), F.col("ln"), grids)).alias(f"s{k}") for k in range(SAMPLES)])


def _digits(prefix: str = "s") -> Column:
    """The fingerprint of the lowest bids in columns; dashes where these are null."""
    return F.concat(*[F.coalesce(F.lower(F.lpad(F.hex(F.col(f"{prefix}{k}").bitwiseAND(F.lit(0xFFFFF))), DIGITS, "0")), F.lit(_EMPTY)) for k in range(SAMPLES)])


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and fingerprint for each row; keys are unique. If rows are dealt by some of the keys, texts are not shuffled."""
    words = rows.select(*keys, F.explode(_words(F.col(text_col))).alias("_w")).where("_w <> ''")
    weighted = words.select(*keys, F.xxhash64("_w").alias("term")).groupBy(*keys, "term").agg(F.log(F.count("*").cast("double")).alias("ln"))
    return rows.select(*keys).join(_lowest(weighted, keys), keys, "left").select(*keys, _digits().alias("fingerprint"))


def _order(light: DataFrame) -> DataFrame:
    """light: row, id, h, n. For each row: the row before it in descending order of id, and how many code points that one's edit takes; the first comes after the last."""
    place = F.col("id").desc_nulls_last(), F.col("h"), F.col("row")
    parted = in_order(light, *place)
    half = F.floor(F.col("n") / 2).cast("int")
    ends = parted.groupBy("_part").agg(F.max_by(F.struct("row", half.alias("half")), "_n").alias("end"))
    by_part = Window.orderBy("_part")  # one row a part
    last = F.last("end").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turns = ends.withColumn("before", F.coalesce(F.lag("end").over(by_part), last)).select("_part", "before")
    own = Window.partitionBy("_part").orderBy("_n")
    found = parted.join(turns, "_part").withColumn("prev", F.coalesce(F.lag(F.struct("row", half.alias("half"))).over(own), F.col("before")))
    return found.select("row", "id", F.col("prev.row").alias("prev"), F.col("prev.half").alias("take"), "n")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """For each row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has the text's last half of code points replaced by the first as many of the next document, by descending id."""
    rows = stable(docs.select(id_col, text_col)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = written(_order(rows.select("row", "id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n"))), "order")
    parts = max(1, math.ceil((order.agg(F.sum("n")).first()[0] or 0) / part_chars))
    dealt = rows.select("row", "text").repartition(parts, "row")  # the same columns wherever it is used, so that texts are shuffled once
    turn = order.select("row", "id", "prev", "take").repartition(parts, "row")
    # the smaller sides are hashed, so that no text is sorted
    gifts = dealt.join(turn.hint("shuffle_hash"), "row").select(F.col("prev").alias("row"), F.expr("left(text, take)").alias("after")).repartition(parts, "row")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = dealt.join(gifts.hint("shuffle_hash"), "row").select("row", "text", F.concat(F.left("text", F.length("text") - half), F.left("after", half)).alias("edited"))

    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    words = edited.select("row", F.inline(texts)).select("row", "which", F.explode(_words(F.col("t"))).alias("w")).where("w <> ''")
    counted = words.groupBy("row", F.xxhash64("w").alias("term")).agg(F.count(F.when(F.col("which") == 0, 1)).alias("m"), F.count(F.when(F.col("which") == 1, 1)).alias("e"))
    side = lambda k, n: F.when(n > 0, F.struct(F.lit(k).alias("side"), F.log(n.cast("double")).alias("ln")))
    m, e = F.col("m"), F.col("e")
    sides = F.when(m == e, F.array(side(2, m))).otherwise(F.filter(F.array(side(0, m), side(1, e)), lambda x: x.isNotNull()))
    lowest = _lowest(counted.select("row", "term", F.inline(sides)), ["row", "side"])
    of = lambda k, other: F.min(F.when(F.col("side") != other, F.col(f"s{k}")))
    both = lowest.groupBy("row").agg(*[of(k, 1).alias(f"a{k}") for k in range(SAMPLES)], *[of(k, 0).alias(f"b{k}") for k in range(SAMPLES)]).select("row", _digits("a").alias("fingerprint"), _digits("b").alias("edited_fingerprint"))

    facts = edited.select("row", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    blank = F.lit(_EMPTY * SAMPLES)
    made = facts.join(both, "row", "left").withColumns({c: F.coalesce(c, blank) for c in ("fingerprint", "edited_fingerprint")})
    made = written(made.join(turn, "row").drop("take"), "made")
    after = made.select(F.col("prev").alias("row"), F.col("fingerprint").alias("after"))
    return made.join(after, "row").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("after")).alias("near_next")
    )
