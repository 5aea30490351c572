"""Searches and record operators: top-k, merge, upsert, deletes, batches of queries, shards, tiers.

A single query's vector is a constant of the plan, so a search is one scan with a projected distance and a bounded top-k in each task
(TakeOrderedAndProject): nothing is shuffled but k rows a task.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.hashing import SHARDS, shard_of
from .sums import group_sums

#: A query batch's vectors travel with the tasks: at most so many numbers at once.
MAX_BATCH_NUMBERS = 8_000_000


def scored(records: DataFrame, query: Column, metric: str = "cosine", vector: str = "vector", mask: Column | None = None) -> DataFrame:
    """records with score, the distance to query."""
    v = F.col(vector)
    return records.withColumn("score", V.distance(metric, v, query) if mask is None else V.weighted(metric, v, query, mask))


def nearest(df: DataFrame, k: int, offset: int = 0, id_col: str = "id") -> DataFrame:
    """By distance, equal ones by id. Rows without a score (other dimensions) are left out."""
    return df.where(F.col("score").isNotNull()).orderBy("score", id_col).offset(offset).limit(k)


def merge(*parts: DataFrame, k: int | None = None, id_col: str = "id", descending: bool = False) -> DataFrame:
    """Each id once with its best score, of scored parts with the same columns; the k best. descending takes scores as similarities."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    rest = [c for c in all_.columns if c not in (id_col, "score")]
    best = (F.max if descending else F.min)(F.struct("score", *rest) if not descending else F.struct("score", *rest)).alias("_b")
    one = all_.groupBy(id_col).agg(best).select(id_col, *[F.col(f"_b.{c}").alias(c) for c in ("score", *rest)])
    order = [F.col("score").desc() if descending else F.col("score").asc(), F.col(id_col)]
    return one.orderBy(*order).limit(k) if k is not None else one


def get(records: DataFrame, record_id: int, id_col: str = "id") -> DataFrame:
    """The record of an id: an equality that prunes row groups."""
    return records.where(F.col(id_col) == record_id).limit(1)


def get_many(records: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return records.join(ids.select(id_col), id_col, "left_semi")


def without(records: DataFrame, deleted: DataFrame, id_col: str = "id") -> DataFrame:
    return records.join(deleted.select(id_col), id_col, "left_anti")


def latest(changes: DataFrame, id_col: str = "id", order: str = "txn_id", op: str | None = None) -> DataFrame:
    """The state after a change log: the last row of each id, without those whose op is 'delete'."""
    rest = [c for c in changes.columns if c not in (id_col, order)]
    last = changes.groupBy(id_col).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.max(order).alias(order))
    out = last.select(id_col, order, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return out.where(F.col(op) != "delete").drop(op) if op else out


def compacted(changes: DataFrame, checkpoint: int = 0, order: str = "txn_id") -> DataFrame:
    """One entry for each transaction after the checkpoint."""
    return changes.where(F.col(order) > checkpoint).dropDuplicates([order])


def coldest(records: DataFrame, n: int, id_col: str = "id", count: str = "access_count") -> tuple[DataFrame, DataFrame]:
    """The n least used, ties by id, and the rest."""
    out = records.orderBy(count, id_col).limit(n)
    return out, records.join(out.select(id_col), id_col, "left_anti")


def knn_join(queries: DataFrame, records: DataFrame, k: int, metric: str = "cosine", vector: str = "vector", id_col: str = "id", block: int = MAX_BATCH_NUMBERS) -> DataFrame:
    """The k nearest records of each query (qid, q): qid, id, score, rank. Queries without a vector have none.

    Queries go to the tasks as matrices of at most block numbers, as many as they need, each with a pass over the records; a task keeps k
    candidates a query, by matrix products over its batches; candidates meet by query in a window that Spark limits before the shuffle.
    """
    qid_type = queries.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", qid_type), T.StructField("id", records.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    own = records.where(F.col(vector).isNotNull()).select(F.col(id_col), F.col(vector))
    best = None
    for qids, q in _query_blocks(queries, block):
        part = own.mapInArrow(_nearest_task(qids, q, k, metric), schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9), "id"))).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All queries as (qids, matrix) of at most block numbers each, one query at least."""
    qids, q, numbers = [], [], 0
    for r in queries.where(F.col("q").isNotNull()).select("qid", V.doubles(F.col("q")).alias("q")).toLocalIterator():
        if q and numbers + len(r["q"]) > block:
            yield np.array(qids), np.array(q)
            qids, q, numbers = [], [], 0
        qids.append(r["qid"])
        q.append(np.array(r["q"], float))
        numbers += len(r["q"])
    if q:
        yield np.array(qids), np.array(q)


def _nearest_task(qids: np.ndarray, q: np.ndarray, k: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (id, vector): the k best of a task for each query."""

    def distances(some: np.ndarray, part: np.ndarray) -> np.ndarray:
        if metric == "euclidean":
            return np.sqrt(np.maximum(0.0, (some**2).sum(1)[:, None] + (part**2).sum(1)[None, :] - 2 * some @ part.T))
        d = 1 - some @ part.T
        if metric == "cosine_full":
            lengths = np.linalg.norm(some, axis=1)[:, None] * np.linalg.norm(part, axis=1)[None, :]
            d = np.where(lengths > 0, 1 - (1 - d) / np.where(lengths > 0, lengths, 1), 1.0)
        return d

    def task(batches):
        kept = {}  # by first query: query, score, id of the best so far, by query
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            m = np.asarray(b.column(1).flatten(), float).reshape(n, -1)
            if m.shape[1] != q.shape[1]:
                raise ValueError(f"records have {m.shape[1]} dimensions, queries {q.shape[1]}")
            ids = np.asarray(b.column(0))
            for first in range(0, len(q), 1024):
                some = q[first : first + 1024]
                for at in range(0, n, 4096):
                    part, names = m[at : at + 4096], ids[at : at + 4096]
                    d = distances(some, part)
                    who, score, name = kept.get(first, (np.zeros(0, np.int64), np.zeros(0), names[:0]))
                    # what is farther than k others cannot stay; scores that round alike can
                    limit = np.full(len(some), np.inf)
                    full = np.bincount(who, minlength=len(some)) >= k
                    limit[full] = score[np.searchsorted(who, np.flatnonzero(full)) + k - 1]
                    if d.shape[1] >= k and not full.all():
                        limit = np.where(full, limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                    row, col = np.nonzero(~(d > limit[:, None] + 2e-9))
                    who, score, name = np.concatenate((who, row)), np.concatenate((score, d[row, col])), np.concatenate((name, names[col]))
                    order = np.lexsort((name, np.round(score, 9), who))
                    who, score, name = who[order], score[order], name[order]
                    stay = np.arange(len(who)) - np.searchsorted(who, who) < k
                    kept[first] = who[stay], score[stay], name[stay]
        for first, (who, score, name) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(qids[first + who]), pa.array(name), pa.array(score)], names=["qid", "id", "score"])

    return task


def shard_top_k(records: DataFrame, query: Column, k: int, shards: int = SHARDS, available: Sequence[int] | None = None, metric: str = "cosine", vector: str = "vector", id_col: str = "id") -> DataFrame:
    """The best k of each shard, then of all, with total and responded (shards asked and answering) and partial. available: shards that answer, if not all; the others' records are missed."""
    answering = range(shards) if available is None else sorted({int(s) for s in available if 0 <= s < shards})
    own = scored(records, query, metric, vector).select(id_col, "score").withColumn("shard", shard_of(F.col(id_col), shards))
    if available is not None:
        own = own.where(F.col("shard").isin(list(answering)))
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("shard").orderBy("score", id_col))).where(F.col("_n") <= k)
    told = {"total": F.lit(shards), "responded": F.lit(len(answering)), "partial": F.lit(len(answering) < shards)}
    return nearest(ranked.drop("_n"), k, id_col=id_col).withColumns(told)


def shard_timeout(within_ms: int | None, shards: int, default_ms: int = 1000) -> int:
    return default_ms if within_ms is None or not shards else max(50, within_ms // shards)


class AllShardsFailed(RuntimeError):
    pass


@dataclass
class Gathered:
    """The best rows of the shards that answered in time."""

    rows: list[Row]
    total: int
    responded: int

    @property
    def partial(self) -> bool:
        return self.responded < self.total


def scattered(records: DataFrame, query: Column, k: int, within_ms: int | None = None, shards: int = SHARDS, default_ms: int = 1000, at_once: int = 16, metric: str = "cosine", vector: str = "vector", id_col: str = "id") -> Gathered:
    """The best k of each shard by a job of its own, then of all. records: stored by shard, so that a job reads its shard's files only. Each job has shard_timeout() from its start, then it is cancelled and its shard left out; if none answers, AllShardsFailed."""
    sc, limit = records.sparkSession.sparkContext, shard_timeout(within_ms, shards, default_ms) / 1000

    def ask(shard: int) -> list[Row] | None:
        tag = f"shard-{uuid.uuid4().hex}"
        watch = threading.Timer(limit, sc.cancelJobsWithTag, [tag])
        sc.addJobTag(tag)
        watch.start()
        began = time.monotonic()
        try:
            rows = nearest(scored(records.where(F.col("shard") == shard), query, metric, vector), k, id_col=id_col).collect()
            return rows if time.monotonic() - began <= limit else None
        except Exception:
            if time.monotonic() - began <= limit:
                raise
            return None
        finally:
            watch.cancel()
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(at_once) as pool:
        answers = [a for a in pool.map(inheritable_thread_target(records.sparkSession)(ask), range(shards)) if a is not None]
    if not answers:
        raise AllShardsFailed(f"none of {shards} shards answered in {limit:g} s")
    best = sorted((r for a in answers for r in a), key=lambda r: (r["score"], r[id_col]))[:k]
    return Gathered(best, shards, len(answers))


def partition_sums(records: DataFrame, partition: str, vector: str = "vector") -> DataFrame:
    """partition, d, s, n: mergeable sums, also with those of records that come later. Records without a partition are one."""
    return group_sums(records, vector, F.col(partition)).withColumnRenamed("value", partition)


def partition_centroids(records: DataFrame, partition: str, vector: str = "vector", before: DataFrame | None = None) -> DataFrame:
    """partition, d, c, n. before: the partition_sums() of earlier records, so that only the new ones are read."""
    part = partition_sums(records, partition, vector)
    if before is not None:
        part = part.unionByName(before).groupBy(partition, "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return part.select(partition, "d", (F.col("s") / F.col("n")).alias("c"), "n")


def nearby_partitions(cents: DataFrame, query: DataFrame, partition: str, threshold: float = 0.15) -> DataFrame:
    """Partitions whose centroid is nearer to the query (one row: q) than threshold, and the distance."""
    q = query.select(F.posexplode("q").alias("d", "x"))
    far = cents.join(F.broadcast(q), "d").groupBy(partition).agg(F.sqrt(F.sum((F.col("c") - F.col("x").cast("double")) ** 2)).alias("distance"))
    return far.where(F.col("distance") < threshold)


def recall(found: DataFrame, exact: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The share of exact's ids that found has, for each query if by is given."""
    hits = exact.join(found.select(*by, "id").withColumn("_hit", F.lit(1)), [*by, "id"], "left")
    return hits.groupBy(*by).agg((F.count("_hit") / F.lit(float(k))).alias("recall"))
