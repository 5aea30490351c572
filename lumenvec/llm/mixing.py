"""Mixing sources to target weights by balanced sampling (the cube method).

Each source has a weight; the mix shares share times all sizes among the sources by weight, but none gets over most times its
own size, and what it can't take is shared again among the others. A source's rate, target over size, is how often each
of its documents is expected: the whole part is certain, the fraction is an inclusion probability. The flight phase moves
the probabilities of three documents at a time along the direction that keeps both their number and their words as
expected, up or down at random with mean zero, until one of them is decided. Blocks of about block_rows documents of a
source are flown independently; the few undecided documents of each block meet again in the next level's
blocks, until one block is left for a source. There documents so large that no few others can make up for them are
decided first, with the others' probabilities scaled to the target, and after the flight a landing of at most LANDING
undecided documents takes the decision that comes nearest to the target.

What a task holds is one block. Sources are ranked by ranges of their names, so there may be as many as documents. Random numbers
come from the seed, the level and the block, and rows are ordered by a hash of the id, so runs agree.

Defined cases: a null or empty text has size 0, documents of size 0 are sampled but take no words; a very long text is a document so large that it is decided
first; a null source is a source, the last one; a source without words has target 0; rows with equal ids, and those with null, are separate documents, told apart by their
size and place in the table; of landings that come equally near the first in binary order is taken; an empty table gives no rows; columns other than the id, the text and the
source are carried or left out, never read, so their names may be any.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, in_order, stable, written

LANDING = 12
#: Tables with a row for each source are sent to all tasks up to so many bytes, which are summed first; beyond, sources meet their rows in a shuffled join.
MAX_SENT = 8 << 20
_EPS = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source of sizes (source, size): source, rank, source_size, n, target. The weights go to the sources by code point, null last, and repeat."""
    grouped = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count("*").alias("n"))
    parted = in_order(grouped, F.col("source").asc_nulls_last())
    before = parted.groupBy("_part").agg(F.count("*").alias("_m")).withColumn("_before", F.sum("_m").over(Window.orderBy("_part")) - F.col("_m"))  # one row a part
    ranked = parted.join(before, "_part").withColumn("rank", F.col("_before") + F.col("_n")).select("source", "source_size", "n", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = written(ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "sources")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = None, F.lit(False)
    while True:  # each round fills at least one source more, mostly many
        held = rows.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if not held["weight"]:
            break
        new = max(0.0, total - (held["cap"] or 0)) / held["weight"]
        if level is not None and new <= level:
            break
        level = new
        full = F.col("weight") * level > F.col("cap")
        if rows.where(full).count() == held["n"]:
            break
    target = F.when(full, F.col("cap")).otherwise(F.col("weight") * float(level or 0.0))
    return rows.select("source", "rank", "source_size", "n", F.least(target, F.col("cap")).alias("target"))


def _few(rows: DataFrame) -> DataFrame:
    """rows of a written table, to be sent to all tasks if their bytes are few."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rows.dtypes if kind == "string"]
    size = rows.agg(F.sum(sum(texts, F.lit(16 * len(rows.columns))))).first()[0] or 0
    return F.broadcast(rows) if size <= MAX_SENT else rows


def fly(p: np.ndarray, size: np.ndarray, rng: random.Random, stop: int = 2) -> None:
    """Decide probabilities in place, keeping their sum and their sum by size, until stop or fewer are undecided (or none can move)."""
    queue = np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist()
    p[p <= _EPS], p[p >= 1 - _EPS] = 0.0, 1.0
    queue.reverse()
    active: list[int] = []
    undecided = len(queue)
    while undecided > stop:
        while len(active) < 3 and queue:
            active.append(queue.pop())
        if len(active) == 3:
            a, b, c = (float(size[k]) for k in active)
            u = [c - b, a - c, b - a]  # orthogonal to (1, 1, 1) and to the sizes
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = [1.0, -1.0]
        else:
            break
        up = down = np.inf
        for k, d in zip(active, u, strict=True):
            if d:
                room, back = (1 - p[k]) / abs(d), p[k] / abs(d)
                up, down = min(up, room if d > 0 else back), min(down, back if d > 0 else room)
        step = up if rng.random() * (up + down) < down else -down
        rest = []
        for k, d in zip(active, u, strict=True):
            p[k] += step * d
            if p[k] <= _EPS:
                p[k] = 0.0
            elif p[k] >= 1 - _EPS:
                p[k] = 1.0
            else:
                rest.append(k)
                continue
            undecided -= 1
        active = rest


def settle(p: np.ndarray, size: np.ndarray, goal: float, rng: random.Random, large: float = 0.05) -> None:
    """Decide units of more than large times the goal one by one, at random where the others can make up for either outcome; after each, the others' probabilities are scaled so that the words stay as expected."""
    for k in np.argsort(-size, kind="stable").tolist():
        if size[k] <= large * goal:
            return
        if not 0 < p[k] < 1:
            continue
        others = (p > 0) & (p < 1)
        others[k] = False
        sure, room = float(size[p == 1].sum()), float(size[others].sum())
        fits = [0 <= goal - sure - x * size[k] <= room for x in (0, 1)]
        take = rng.random() < p[k] if fits[0] == fits[1] else fits[1]
        p[k] = float(take)
        need = goal - sure - take * size[k]
        for _ in range(50):  # scale, and again where some reach 1
            free = others & (p < 1)
            now, full = float(p[free] @ size[free]), float(size[others & ~free].sum())
            if now <= 0 or abs(now + full - need) <= _EPS * max(1.0, goal):
                break
            p[free] = np.clip(p[free] * max(0.0, need - full) / now, 0.0, 1.0)
        p[others] = np.clip(p[others], 2 * _EPS, 1 - 2 * _EPS) if need > 0 else p[others]


def land(p: np.ndarray, size: np.ndarray, goal: float) -> None:
    """Decide the rest in place, so that the words taken come nearest to goal, then the number of documents to its expectation."""
    rest = np.flatnonzero((p > 0) & (p < 1))
    if not len(rest):
        return
    sure, n = float(size[p == 1].sum()), float(p[rest].sum())
    choices = np.array(list(itertools.product((0.0, 1.0), repeat=len(rest))))
    off = np.abs(sure + choices @ size[rest] - goal)
    p[rest] = choices[np.lexsort((np.abs(choices.sum(1) - n), off))[0]]


def sample(units: DataFrame, seed: int = 0, block_rows: int = 1000) -> DataFrame:
    """units: id, row, source, rank, size, p and other columns. Decides every p to 0 or 1; p's sums by source stay, but for the landing."""
    schema, done, level = units.schema, None, 0

    def one(t: pa.Table) -> pa.Table:
        rank, block, blocks = (t[c][0].as_py() for c in ("rank", "_block", "_blocks"))
        t = t.sort_by([(c, "ascending") for c in ("_h", "id", "size", "row")])
        p, size = t["p"].to_numpy().copy(), t["size"].to_numpy().astype(float)
        goal = float(p @ size)
        rng = random.Random(f"{seed} {level} {rank} {block}")
        if blocks == 1:
            settle(p, size, goal, rng)
        fly(p, size, rng, LANDING if blocks == 1 else 2)
        if blocks == 1:
            land(p, size, goal)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).select(schema.names)

    while True:
        blocks = written(units.groupBy("rank").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("long").alias("_blocks")), "blocks")
        dealt = units.join(_few(blocks), "rank").withColumn("_h", F.xxhash64(F.lit(seed), "id", "size", F.when(F.col("id").isNull(), F.col("row")))).withColumn("_block", F.pmod(F.xxhash64(F.lit(level), "_h"), F.col("_blocks")))
        # one column: rows that the join has dealt by rank would otherwise stay together, a source in one task
        dealt = dealt.withColumn("_unit", F.concat_ws("/", "rank", "_block"))
        flown = written(dealt.groupBy("_unit").applyInArrow(one, schema), "flown")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        sure = flown.where(~open_)
        done = sure if done is None else done.unionByName(sure)
        units = flown.where(open_)
        level += 1
        if units.isEmpty():
            return done


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """For each row of docs: id, source, row (its place in the table), size, source_size, target, copies."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    place = F.monotonically_increasing_id().alias("row")
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), place), "sizes")
    by = written(targets(sizes, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sizes.join(_few(by.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")), "inner")
    whole = F.floor(rate + 1e-12)
    units = joined.select("id", "row", "source", "rank", "size", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(F.lit(0.0), rate - whole).alias("p"))
    return sample(units, seed).select("id", "source", "row", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """For each row of docs: the id, source, size, source_size, target (of its source), copies and taken (copies times size)."""
    how = _taken(docs, id_col, text_col, source_col, **options)
    return how.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs. Rows meet their copies by their place in the table; what a shuffle deals out is written first, so that places stay."""
    docs = stable(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    how = _taken(docs, id_col, text_col, source_col, **options).where("copies > 0").select("row", "copies")
    return rows.join(how, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
