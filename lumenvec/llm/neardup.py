"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles (64-bit hashes). Documents with equal sets form a class and are
represented by the smallest id, so copies cost one row each. Of every set BANDS * ROWS minima are taken; ROWS of them hashed
together are a band key, and the low BITS bits of all are packed into a signature. Two sets that share a band key are
candidates; the number of equal places in their signatures, corrected for the chance collisions of so few bits,
estimates their similarity, and what is not clearly below the threshold is confirmed on the full sets. At a similarity of
0.85 a pair shares no band key with probability 1e-9.

Documents of a bucket (one band key) are not paired with each other. First each is compared with one pivot of each of its buckets, the
most promising pivot. Linked documents become components. Where a bucket still holds several, signatures tell (in blocks of bounded
size) which components have promising pairs, and these form families. In each family the documents outside
its largest component are compared with all others of other components, in blocks that hold their full sets, and only links that connect
components leave a block. So what is written grows with the documents, however large a group of near copies is,
and no link between components is missed.

A bucket of n documents of other components each is compared in blocks: its signatures are read about 2 n / block times, with blocks that grow with n.

Defined cases: a text without words, empty, or null, has no shingles and links with nothing, so it is kept; one with fewer words than a shingle has one
shingle, its whole sequence; a very long text is one set, whose minima are taken piece by piece; repeated rows are copies, of which deduplicated() leaves one; of documents as promising the pivot with the smaller id is
compared first; rows with equal ids and other texts are one document to their links; a row without id joins the component of its copies and near copies like any other (its place in the table stands for the id, after all ids; what a shuffle
deals out is written first, so that places stay), and where none of these has an id, one row is kept and component_id is null; an empty table gives no rows; columns other than the id and the text
are carried or left out, never read, so their names may be any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, stable, written

BANDS, ROWS, BITS = 28, 4, 4
PLACES = BANDS * ROWS
WORDS64 = PLACES * BITS // 64
#: Estimates lower than the threshold by more than this are not confirmed: over five standard deviations.
SLACK = 0.2
BLOCK, SHARD_ROWS, SET_WEIGHT = 1024, 2000, 1500
#: Stands for the id of rows without one, with their place in the table added: above all ids.
NO_ID = 1 << 62

_rng = np.random.default_rng(20240131)
_A = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_MARK = np.uint64(0x1111111111111111)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles of lower-cased (A-Z) words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out *= _P
        out += h[k : k + n]
    return np.unique(_mix(out))


def minima(sets: np.ndarray) -> np.ndarray:
    out = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 512):
        np.minimum(out, (sets[at : at + 512, None] * _A + _B).min(0), out=out)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """Signatures from minima: BITS bits each, in int64 words."""
    low = _mix(low) & np.uint64((1 << BITS) - 1)
    each = 64 // BITS
    shift = (np.arange(each, dtype=np.uint64) * np.uint64(BITS))[None, :]
    return np.bitwise_or.reduce(low.reshape(WORDS64, each) << shift, axis=1).view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        h = _mix(h * _P + mins.reshape(BANDS, ROWS)[:, k])
    return h.view(np.int64)


_SIG = T.StructType([T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.ArrayType(T.LongType()))])
_SIG_ARROW = pa.struct([("n", pa.int64()), ("set", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])
_SET = T.StructType([T.StructField("set", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
_SET_ARROW = pa.struct([("set", pa.binary()), ("shingles", pa.list_(pa.int64()))])


def _digest(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()


def _signatures(width: int):
    @F.arrow_udf(_SIG)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts:
                s = shingles(t.as_py(), width)
                if len(s):
                    m = minima(s)
                    rows.append({"n": len(s), "set": _digest(s), "bands": band_keys(m), "sig": packed(m)})
                else:
                    rows.append({"n": 0, "set": None, "bands": None, "sig": None})
            yield pa.array(rows, _SIG_ARROW)

    return udf


def _sets(width: int):
    @F.arrow_udf(_SET)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shingles(t.as_py(), width) for t in texts]
            yield pa.array([{"set": _digest(s), "shingles": s.view(np.int64)} for s in found], _SET_ARROW)

    return udf.asNondeterministic()  # else a filter on its result is moved below the join that picks the texts, and all texts are taken


@F.arrow_udf(T.LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many elements two sorted distinct lists share."""
    out = []
    x, y = (np.asarray(c.flatten()).view(np.uint64) for c in (a, b))
    i, j = (np.concatenate(([0], np.cumsum(np.asarray(c.value_lengths())))) for c in (a, b))
    for k in range(len(a)):
        p, q = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
        out.append(len(p) + len(q) - len(np.unique(np.concatenate((p, q)))))
    return pa.array(out, pa.int64())


def equal_places(a: Column, b: Column) -> Column:
    """How many places of two signatures are equal, by bit counts."""
    off = []
    for k in range(WORDS64):
        x = a[k].bitwiseXOR(b[k])
        any_bit = reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(x, s) for s in range(1, BITS)], x)
        off.append(F.bit_count(any_bit.bitwiseAND(F.lit(int(_MARK)))))
    return F.lit(PLACES) - reduce(lambda p, q: p + q, off)


def least_places(threshold: float) -> int:
    """Pairs with fewer equal places are clearly below the threshold: the estimate is (equal share - c) / (1 - c) with c the chance of a collision."""
    chance = 2.0**-BITS
    return int(np.ceil(PLACES * (chance + (1 - chance) * (threshold - SLACK))))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for links (a, b): the smallest id reachable. Labels move along links, then to the label of the label."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels: DataFrame = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        moved = labels.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        target = labels.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        jumped = written(moved.join(target, "c").select("id", "old", F.least("c", "cc").alias("c")), "labels")
        dropped(labels)
        labels = jumped
        if jumped.where("old <> c").isEmpty():
            dropped(both)
            return labels.select("id", F.col("c").alias("component"))


class _Joined:
    """Union by smallest root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _units(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of strays and of members in each unit of a sorted shard."""
    unit = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
    cut = (np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(0)) + 1).tolist()
    stray = t["stray"].to_numpy(zero_copy_only=False)
    for a, b in zip([0, *cut], [*cut, t.num_rows], strict=True):
        yield a + np.flatnonzero(stray[a:b]), a + np.flatnonzero(~stray[a:b])


def _promising(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, strays: np.ndarray, members: np.ndarray, least: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of different components that may be links by size and signature, a few strays at a time, with their equal places."""
    for at in range(0, len(strays), 64):
        own = strays[at : at + 64]
        off = np.zeros((len(own), len(members)), np.int64)
        for k in range(WORDS64):
            x = sig[own, k][:, None] ^ sig[members, k][None, :]
            x |= x >> np.uint64(2)
            x |= x >> np.uint64(1)
            off += np.bitwise_count(x & _MARK)
        p, q = n[own][:, None], n[members][None, :]
        good = (PLACES - off >= least) & (comp[own][:, None] != comp[members][None, :]) & (100 * np.minimum(p, q) >= percent * np.maximum(p, q))
        i, j = np.nonzero(good)
        yield own[i], members[j], PLACES - off[i, j]


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rep, comp, n = (t[c].to_numpy() for c in ("rep", "component", "n"))
    return rep, comp, n, np.asarray(t["sig"].combine_chunks().flatten()).reshape(-1, WORDS64).view(np.uint64)


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})


def _near_components(t: pa.Table, least: int, percent: int) -> pa.Table:
    """A forest over the components that promising pairs in the buckets of a shard connect: fewer rows than it reads."""
    t = t.sort_by([(c, "ascending") for c in ("key", "i", "j")])
    _, comp, n, sig = _columns(t)
    joined, found = _Joined(), []
    for strays, members in _units(t):
        for x, y, _ in _promising(sig, n, comp, strays, members, least, percent):
            for p, q in np.unique(np.stack([comp[x], comp[y]], 1), axis=0).tolist():
                if joined.join(p, q):
                    found.append((p, q))
    return _pairs(found)


def _links_across(t: pa.Table, least: int, percent: int) -> pa.Table:
    """Links, confirmed on full sets, that connect components in the units of a shard: fewer rows than it reads. The most promising pairs come first, and pairs already connected need no confirmation."""
    t = t.sort_by([(c, "ascending") for c in ("key", "i", "j", "rep")])
    rep, comp, n, sig = _columns(t)
    sets = t["shingles"].combine_chunks()
    flat, start = np.asarray(sets.flatten()).view(np.uint64), np.concatenate(([0], np.cumsum(n)))
    joined, found = _Joined(), []
    for strays, members in _units(t):
        for x, y, places in _promising(sig, n, comp, strays, members, least, percent):
            for k in np.argsort(-places, kind="stable").tolist():
                p, q = int(x[k]), int(y[k])
                if joined.root(int(comp[p])) == joined.root(int(comp[q])):
                    continue
                both = np.concatenate((flat[start[p] : start[p + 1]], flat[start[q] : start[q + 1]]))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    joined.join(int(comp[p]), int(comp[q]))
                    found.append((int(rep[p]), int(rep[q])))
    return _pairs(found)


def _dealt(rows: DataFrame, groups: DataFrame, block: int, shard: int, larger: int = 1) -> DataFrame:
    """Rows (key, rep, component, ...) of groups (key, all, most, main) in units of about block members by block strays at most, by weight, a few units to a shard.

    Members are all rows of a group, strays those outside its main component. Blocks of large groups hold up to larger times as much, so that their rows are copied to fewer."""
    size = F.greatest(F.lit(block), F.least(F.lit(larger * block), F.col("all") / 16))
    parts = groups.select("key", "main", "all", "most", F.ceil(F.col("all") / size).cast("int").alias("nb"), F.ceil((F.col("all") - F.col("most")) / size).cast("int").alias("ns"))
    laid = rows.join(parts.drop("all", "most"), "key")
    h = F.xxhash64("rep")
    members = laid.select("*", F.lit(False).alias("stray"), F.pmod(h, F.col("nb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("j"))
    strays = laid.where("component <> main").select("*", F.lit(True).alias("stray"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), F.pmod(h, F.col("ns")).cast("int").alias("j"))
    n = parts.agg(F.sum(F.col("all") * F.col("ns") + (F.col("all") - F.col("most")) * F.col("nb"))).first()[0] or 0  # with all copies
    return members.unionByName(strays).drop("main", "nb", "ns").withColumn("shard", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n // shard + 1)))


def _mixed(rows: DataFrame, weight: Column) -> DataFrame:
    """(key, all, most, main) of the groups of rows (key, component) with several components: the weight in all, in the heaviest component, and which that is."""
    parts = rows.groupBy("key", "component").agg(F.sum(weight).alias("m"))
    return parts.groupBy("key").agg(F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("component", F.struct("m", -F.col("component"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 85) -> DataFrame:
    """For each row of docs: row (its place), id (or NO_ID and the place), n, component (an id of that kind), and whether it is the first row of its set."""
    docs, least = stable(docs), least_places(percent / 100)
    place = F.monotonically_increasing_id()
    rows = docs.select(place.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + place).alias("id"), F.col(text_col).alias("t"))
    signed = written(rows.select("row", "id", _signatures(width)(F.col("t")).alias("s")).select("row", "id", "s.*"), "signed")
    first = F.min(F.struct("id", "row"))
    reps = signed.where("set is not null").groupBy("set").agg(first.alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    reps = written(reps.select("set", F.col("first.id").alias("rep"), F.col("first.row").alias("first"), "n", "bands", "sig"), "reps")
    # buckets of two and more, each with its smallest id
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    pivots = buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    shared = written(buckets.join(pivots, "key"), "shared")
    light = reps.select("rep", "n", "sig")

    def estimated(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with their equal places, without those clearly below the threshold."""
        x = light.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        y = light.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        close = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        return pairs.join(x, "a").join(y, "b").where(close).select("a", "b", equal_places(F.col("sa"), F.col("sb")).alias("places")).where(F.col("places") >= least)

    def full_sets(ends: DataFrame) -> DataFrame:
        """(rep, shingles) for the reps in ends, from the texts of just these documents."""
        own = ends.distinct().join(reps.select("rep", "set"), "rep").withColumnRenamed("set", "own")
        texts = rows.select(F.col("id").alias("rep"), "t").join(own, "rep")
        # rows with equal ids may have other texts
        return texts.select("rep", "own", _sets(width)("t").alias("s")).where(F.col("own") == F.col("s.set")).select("rep", F.col("s.shingles").alias("shingles")).dropDuplicates(["rep"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs that are links by their full sets."""
        full = written(full_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep"))), "sets")
        joined = pairs.select("a", "b").join(full.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(full.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
        counted = joined.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), _common("sa", "sb").alias("common"))
        links = written(counted.where(100 * F.col("common") >= percent * (F.col("n") - F.col("common"))).select("a", "b"), "links")
        dropped(full)
        return links

    # a is the pivot, the smaller one; b is compared with its most promising pivot
    near_pivots = written(estimated(shared.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()), "pairs")
    best = near_pivots.groupBy("b").agg(F.max_by("a", F.struct("places", -F.col("a"))).alias("a")).select("a", "b")
    links = confirmed(best)
    found = components(links)

    # what is left: components that promising pairs connect, in buckets of three and more or by another pivot
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    labelled = written(shared.select("key", "rep").join(of("rep"), "rep", "left").select("key", "rep", F.coalesce("crep", "rep").alias("component")), "labelled")
    units = _dealt(labelled, _mixed(labelled, F.lit(1)).where("all > 2"), BLOCK // 2, SHARD_ROWS // 2, larger=32).join(light, "rep")
    near = units.groupBy("shard").applyInArrow(lambda t: _near_components(t, least, percent), "a bigint, b bigint")
    others = near_pivots.select("a", "b").join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    edges = written(near.unionByName(others).distinct(), "near")
    dropped(shared, near_pivots, labelled)
    if not edges.isEmpty():
        # every such pair lies in one family of components; in each, strays and members are compared with their full sets at hand
        family = components(edges).select(F.col("id").alias("component"), F.col("component").alias("key"))
        label = light.join(of("rep"), "rep", "left").select("rep", "n", "sig", F.coalesce("crep", "rep").alias("component")).join(family, "component")
        active = written(label.select("key", "component", "rep", "n", "sig"), "active")
        with_sets = written(active.join(full_sets(active.select("rep")), "rep"), "active-sets")
        dealt = _dealt(with_sets, _mixed(active, F.col("n") + SET_WEIGHT), BLOCK * SET_WEIGHT, SHARD_ROWS * SET_WEIGHT)  # long documents count more, so that a block's sets fit in memory
        more = written(dealt.groupBy("shard").applyInArrow(lambda t: _links_across(t, least, percent), "a bigint, b bigint"), "links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
        dropped(active, with_sets, more)
    dropped(edges, links)

    classes = reps.select("set", "first", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set", "first", F.coalesce("component", "rep").alias("component"))
    out = signed.select("row", "id", "n", "set").join(classes, "set", "left")
    alone = F.col("n") == 0
    return out.select("row", "id", "n", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"), (alone | (F.col("row") == F.col("first"))).alias("first"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """For each row of docs: the id, n_shingles, component_id and kept."""
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return _classified(docs, id_col, text_col, **options).select(known("id").alias(id_col), F.col("n").alias("n_shingles"), known("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with the columns of docs."""
    docs = stable(docs)
    kept = _classified(docs, id_col, text_col, **options).where((F.col("id") == F.col("component")) & F.col("first")).select("row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
