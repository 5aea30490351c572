"""A table of clusters: nearest-centroid assignment, running means, splits, a hash tree, and searches that probe the nearest clusters only, a fixed number or as many as the k-th distance needs.

Clusters: cluster_id, centroid, n. They travel to the tasks in blocks of a bounded number of numbers; records never do. What needs all of them at the driver
(radii, safe probing, the hash tree) takes max_clusters at most, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.hashing import leaf_hash, parent_hash
from .search import nearest, scored
from .sums import group_sums

SCHEMA = "cluster_id bigint, centroid array<double>, n bigint"
MAX_CLUSTERS = 20_000
#: Numbers of centroids that travel with the tasks at once.
MAX_BLOCK_NUMBERS = 4_000_000
#: Records and centroids whose distances a task holds at once.
TILE_RECORDS, TILE_CENTROIDS = 512, 1024


def _matrix(clusters: DataFrame, max_clusters: int) -> tuple[np.ndarray, np.ndarray]:
    rows = clusters.select("cluster_id", "centroid").orderBy("cluster_id").limit(max_clusters + 1).collect()
    if len(rows) > max_clusters:
        raise ValueError(f"over {max_clusters} clusters")
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)


def assign(records: DataFrame, clusters: DataFrame, vector: str = "vector", block: int = MAX_BLOCK_NUMBERS) -> DataFrame:
    """records with cluster_id, that of the nearest centroid by full cosine, equal ones by id; null without a vector or clusters. One pass, no shuffle: centroids go to the tasks in blocks of at most block numbers, each of which names its nearest, and the least of these is taken. Distances are held for a tile of records and centroids only; a task holds all centroids, 16 bytes a number."""
    best = [_nearest_in(ids, cents)(F.col(vector)) for ids, cents in _blocks(clusters, block)]
    if not best:
        return records.withColumn("cluster_id", F.lit(None).cast("bigint"))
    return records.withColumn("cluster_id", (F.least(*best) if len(best) > 1 else best[0])["id"])


def _blocks(clusters: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, cents, numbers = [], [], 0
    for r in clusters.select("cluster_id", "centroid").orderBy("cluster_id").toLocalIterator():
        if ids and numbers + len(r[1]) > block:
            yield np.array(ids, np.int64), np.array(cents, float)
            ids, cents, numbers = [], [], 0
        ids.append(r[0])
        cents.append(r[1])
        numbers += len(r[1])
    if ids:
        yield np.array(ids, np.int64), np.array(cents, float)


def _nearest_in(ids: np.ndarray, cents: np.ndarray):
    """The distance and id of the nearest centroid for each vector."""
    lengths = np.linalg.norm(cents, axis=1)
    unit = cents / np.where(lengths > 0, lengths, 1)[:, None]

    @F.arrow_udf("far double, id bigint")
    def nearest_id(batch: pa.Array) -> pa.Array:
        none = np.asarray(batch.is_null())
        known = batch.drop_null()
        far, out, places = np.zeros(len(batch)), np.zeros(len(batch), np.int64), np.flatnonzero(~none)
        for a in range(0, len(known), TILE_RECORDS):
            some = known.slice(a, TILE_RECORDS)
            m = np.asarray(some.flatten(), float).reshape(len(some), -1)
            size = np.linalg.norm(m, axis=1)
            m = m / np.where(size > 0, size, 1)[:, None]
            best, at = np.full(len(m), np.inf), np.zeros(len(m), np.int64)
            for c in range(0, len(unit), TILE_CENTROIDS):
                d = m @ unit[c : c + TILE_CENTROIDS].T
                np.round(np.subtract(1, d, out=d), 12, out=d)
                own = d.argmin(1)
                both = np.stack([best, d[np.arange(len(d)), own]])
                later = both.argmin(0) == 1  # equal ones stay with the earlier tile, where ids are smaller; NaN comes first, as within a tile
                best, at = both.min(0), np.where(later, c + own, at)
            to = places[a : a + TILE_RECORDS]
            far[to], out[to] = best, ids[at]
        return pa.StructArray.from_arrays([pa.array(far, pa.float64(), mask=none), pa.array(out, pa.int64(), mask=none)], names=["far", "id"])

    return nearest_id


def updated(clusters: DataFrame, assigned: DataFrame, vector: str = "vector") -> DataFrame:
    """Clusters with the means and counts of their new members taken in."""
    part = group_sums(assigned, vector, F.col("cluster_id")).select(F.col("value").alias("cluster_id"), "d", "s", F.col("n").alias("m"))
    new = part.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("s"), F.max("m").alias("m"))
    both = clusters.join(new, "cluster_id", "left")
    mean = F.zip_with("centroid", "s", lambda c, s: (c * F.col("n") + s) / (F.col("n") + F.col("m")))
    return both.select("cluster_id", F.when(F.col("m").isNull(), F.col("centroid")).otherwise(mean).alias("centroid"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))


def started(records: DataFrame, vector: str = "vector", id_col: str = "id") -> DataFrame:
    """The first batch: every record is a cluster of its own."""
    return records.select(F.col(id_col).cast("bigint").alias("cluster_id"), F.col(vector).cast("array<double>").alias("centroid"), F.lit(1).cast("bigint").alias("n"))


def split(clusters: DataFrame, max_n: int, step: float = 0.01) -> DataFrame:
    """Clusters of more than max_n become two, with all dimensions shifted by -step and step and half the count each, until none is over. New ids follow the largest."""
    clusters = clusters.persist()  # a row a cluster, read in each round; the records behind it are not
    while True:
        top = clusters.agg(F.max("cluster_id")).first()[0]
        big = clusters.where(F.col("n") > max_n)
        n = big.count()
        if not n:
            return clusters
        ordered = big.select("*", F.row_number().over(_by_id()).alias("k"))  # as many rows as clusters are too large
        low = F.struct((F.lit(top) + 2 * F.col("k") - 1).cast("bigint").alias("cluster_id"), F.transform("centroid", lambda x: x - step).alias("centroid"), F.floor(F.col("n") / 2).cast("bigint").alias("n"))
        high = F.struct((F.lit(top) + 2 * F.col("k")).cast("bigint").alias("cluster_id"), F.transform("centroid", lambda x: x + step).alias("centroid"), (F.col("n") - F.floor(F.col("n") / 2)).cast("bigint").alias("n"))
        clusters = clusters.where(F.col("n") <= max_n).unionByName(ordered.select(F.inline(F.array(low, high))))


def _by_id():
    from pyspark.sql.window import Window

    return Window.orderBy("cluster_id")


def insert(clusters: DataFrame | None, records: DataFrame, max_n: int, vector: str = "vector") -> DataFrame:
    """A batch into the clusters: assigned to those that exist, means updated, too large ones split."""
    if clusters is None or clusters.isEmpty():
        return split(started(records, vector), max_n)
    return split(updated(clusters, assign(records, clusters, vector), vector), max_n)


def tree(clusters: DataFrame, max_clusters: int = MAX_CLUSTERS) -> list[list[dict]]:
    """Levels of the hash tree, leaves first: centroid, n, hash. Neighbours by id are paired; an odd one moves up."""
    rows = clusters.orderBy("cluster_id").limit(max_clusters + 1).collect()
    if len(rows) > max_clusters:
        raise ValueError(f"over {max_clusters} clusters")
    level = [{"cluster_id": r["cluster_id"], "centroid": list(r["centroid"]), "n": r["n"], "hash": leaf_hash(r["centroid"], r["n"], r["cluster_id"])} for r in rows]
    out = [level]
    while len(level) > 1:
        up = []
        for a, b in zip(level[::2], level[1::2], strict=False):
            n = a["n"] + b["n"]
            up.append({"centroid": [(x * a["n"] + y * b["n"]) / n for x, y in zip(a["centroid"], b["centroid"], strict=True)], "n": n, "hash": parent_hash(a["hash"], b["hash"])})
        level = up + level[len(up) * 2 :]
        out.append(level)
    return out


def nearest_clusters(clusters: DataFrame, query: Column, k: int) -> DataFrame:
    """cluster_id and score of the k nearest centroids: which clusters to probe, not records."""
    return nearest(clusters.select(F.col("cluster_id").alias("id"), V.cosine_full(F.col("centroid"), query).alias("score")), k)


def probe(records: DataFrame, clusters: DataFrame, query: Column, k: int, probes: int, metric: str = "cosine", vector: str = "vector") -> DataFrame:
    """The k nearest of the records (with cluster_id) in the nearest clusters; where records are partitioned by cluster_id, the others' files aren't read."""
    ids = [r["id"] for r in nearest_clusters(clusters, query, probes).collect()]
    return nearest(scored(records.where(F.col("cluster_id").isin(ids)), query, metric, vector), k)


def with_radius(clusters: DataFrame, assigned: DataFrame, vector: str = "vector", max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """clusters with radius, the largest Euclidean distance of a member (assigned: with cluster_id) from the centroid; null without members. Part of building an index."""
    ids, cents = _matrix(clusters, max_clusters)
    row = {int(c): k for k, c in enumerate(ids)}

    @F.arrow_udf(T.DoubleType())
    def away(cluster: pa.Array, batch: pa.Array) -> pa.Array:
        out = np.array([np.linalg.norm(np.asarray(v, float) - cents[row[c]]) if v is not None and c in row else np.nan for c, v in zip(cluster.to_pylist(), batch.to_pylist(), strict=True)])
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    far = assigned.select("cluster_id", away(F.col("cluster_id"), F.col(vector)).alias("r")).groupBy("cluster_id").agg(F.max("r").alias("radius"))
    return clusters.join(far, "cluster_id", "left")


def probe_safe(records: DataFrame, clusters: DataFrame, query: Sequence[float], k: int, probes: int = 1, vector: str = "vector", max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """The k nearest of the records (with cluster_id) by cosine distance (1 - dot), all of them right: clusters carry radius (with_radius).

    The nearest clusters give a k-th distance; a member's distance is at least 1 - query.centroid - |query| radius, so only clusters where
    that is more are left out. Records of clusters that the table doesn't have are read too."""
    ids, cents = _matrix(clusters, max_clusters)
    if not len(ids):
        return nearest(scored(records, V.literal(query), "cosine", vector), k)
    q = np.array(query, float)
    size = {r[0]: r[1] for r in clusters.where("radius is not null").select("cluster_id", "radius").collect()}
    bound = np.array([1 - c @ q - np.linalg.norm(q) * size[int(i)] if int(i) in size else np.inf for i, c in zip(ids, cents, strict=True)])
    first = ids[np.argsort(bound, kind="stable")[:probes]].tolist()
    found = nearest(scored(records.where(F.col("cluster_id").isin(first)), V.literal(query), "cosine", vector), k).select("score").collect()
    worst = found[-1][0] if len(found) == k else np.inf
    far = ids[(bound > worst + 1e-6) & np.isfinite(bound)].tolist()
    near = F.coalesce(~F.col("cluster_id").isin(far), F.lit(True)) if far else F.lit(True)
    return nearest(scored(records.where(near), V.literal(query), "cosine", vector), k)


def trained(spark: SparkSession, records: DataFrame, n: int, rounds: int = 5, sample: int = 20_000, vector: str = "vector", id_col: str = "id", seed: int = 1) -> DataFrame:
    """n clusters by k-means on a sample of at most sample records (the smallest hashes of ids), for probing."""
    rows = records.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(seed), F.col(id_col))).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).collect()
    m = np.array([r["v"] for r in rows], float)
    cents = m[: min(n, len(m))].copy()
    for _ in range(rounds):
        at = np.argmin(((m[:, None, :] - cents[None]) ** 2).sum(2), 1) if len(m) * len(cents) < 2_000_000 else np.array([np.argmin(((x - cents) ** 2).sum(1)) for x in m])
        for c in range(len(cents)):
            if (at == c).any():
                cents[c] = m[at == c].mean(0)
    return spark.createDataFrame([(i, c.tolist(), int((at == i).sum())) for i, c in enumerate(cents)], SCHEMA)
