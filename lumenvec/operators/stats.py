"""Statistics of vectors by metadata, and the query bias that follows from them.

Every statistic is one pass in which each task adds up its vectors: what is shuffled is a row for each group, dimension and map task,
never a vector. The results are small (groups times dimensions) and can be kept as tables: (value, d, s, n) with sums and counts, which
merge by addition, and moments, which merged_moments() merges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.nodes import BiasFilter
from .sums import group_sums, merged_moments, moments


def global_centroid(records: DataFrame, vector: str = "vector") -> DataFrame:
    return group_sums(records, vector).select("d", (F.col("s") / F.col("n")).alias("c"))


def sums(records: DataFrame, field: str, vector: str = "vector") -> DataFrame:
    """Mergeable: value, d, s, n for the rows that have the field."""
    return group_sums(records.where(F.col(field).isNotNull()), vector, F.col(field))


def merged(*parts: DataFrame) -> DataFrame:
    """Sums of several batches."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("value", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def centroids(part: DataFrame) -> DataFrame:
    return part.select("value", "d", (F.col("s") / F.col("n")).alias("c"))


def deltas(part: DataFrame) -> DataFrame:
    """value, d, delta: the centroid less that of all rows that have the field."""
    all_ = part.groupBy("d").agg((F.sum("s") / F.sum("n")).alias("g"))
    return centroids(part).join(all_, "d").select("value", "d", (F.col("c") - F.col("g")).alias("delta"))


def category_deltas(records: DataFrame, field: str, vector: str = "vector") -> DataFrame:
    """Deltas of categories against the centroid of all records, those without the field too."""
    own = centroids(sums(records, field, vector)).withColumnRenamed("c", "own")
    return own.join(global_centroid(records, vector), "d").select("value", "d", (F.col("own") - F.col("c")).alias("delta"))


def bucket_of(value: Column, bounds: Sequence[float]) -> Column:
    """The last bound that is not above the value; the first bucket also has all below."""
    if not bounds:
        raise ValueError("boundaries must not be empty")
    own = F.array(*[F.lit(float(b)) for b in bounds])
    return F.greatest(F.lit(0), F.size(F.filter(own, lambda b: b <= value)) - 1)


def bucket_sums(records: DataFrame, field: str, bounds: Sequence[float], vector: str = "vector") -> DataFrame:
    return sums(records.where(F.col(field).isNotNull()).withColumn("_bucket", bucket_of(F.col(field).cast("double"), bounds)), "_bucket", vector)


def bucket_range(f: BiasFilter, bounds: Sequence[float]) -> tuple[int, int]:
    """First and last bucket that a filter takes."""
    at = lambda v: max(0, sum(b <= v for b in bounds) - 1)
    own, last = at(float(f.value)), len(bounds) - 1
    if f.op == "range":
        return own, at(float(f.high))
    return {"=": (own, own), ">": (own, last), ">=": (own, last), "<": (0, own), "<=": (0, own)}[f.op]


def bucket_delta(part: DataFrame, f: BiasFilter, bounds: Sequence[float]) -> DataFrame:
    """d, delta: the plain mean of the deltas of the buckets that have rows."""
    low, high = bucket_range(f, bounds)
    return deltas(part).where(F.col("value").between(low, high)).groupBy("d").agg(F.avg("delta").alias("delta"))


def correlated(merged: DataFrame) -> DataFrame:
    """d, r, mean from merged moments: Pearson's r of the field and each dimension, 0 with fewer than two rows or without variance, and the field's mean."""
    r = F.coalesce(F.try_divide(F.col("xv"), F.sqrt(F.col("xx")) * F.sqrt(F.col("vv"))), F.lit(0.0))
    return merged.select("d", F.when(F.col("n") < 2, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"), F.col("mx").alias("mean"))


def correlations(records: DataFrame, field: str, vector: str = "vector") -> DataFrame:
    """d, r, mean of the records; see correlated."""
    return correlated(merged_moments(moments(records, vector, F.col(field))))


def field_mean(records: DataFrame, field: str) -> DataFrame:
    return records.agg(F.avg(F.col(field).cast("double")).alias("mean"))


def selectivity(records: DataFrame, condition: Column) -> DataFrame:
    """The share of records that a condition takes."""
    return records.agg(F.avg(F.when(condition, 1.0).otherwise(0.0)).alias("selectivity"))


def adaptive_alpha(share: float) -> float:
    return min(0.7, max(0.2, 0.2 + 0.5 * (1 - share)))


@dataclass
class Kept:
    """Statistics as tables, so that a query reads a few rows for each dimension instead of the records: sums by field (for bucketed fields by bucket),
    the centroid of all records (d, c), and correlations by field (d, r, mean)."""

    sums: dict[str, DataFrame] = field(default_factory=dict)
    centroid: DataFrame | None = None
    correlations: dict[str, DataFrame] = field(default_factory=dict)


def gathered(records: DataFrame, path: str, categorical: Sequence[str] = (), buckets: dict[str, Sequence[float]] | None = None, numeric: Sequence[str] = (), vector: str = "vector") -> Kept:
    """Compute the statistics once and keep them as Parquet under path."""
    spark = records.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.repartition(1).write.mode("overwrite").parquet(f"{path}/{name}")  # groups times dimensions: small; what makes them stays spread
        return spark.read.parquet(f"{path}/{name}")

    kept = Kept(centroid=stored(global_centroid(records, vector), "centroid"))
    for f in categorical:
        kept.sums[f] = stored(sums(records.withColumn("_v", F.col(f).cast("string")), "_v", vector), f"sums-{f}")
    for f, bounds in (buckets or {}).items():
        kept.sums[f] = stored(bucket_sums(records, f, bounds, vector), f"sums-{f}")
    for f in numeric:
        kept.correlations[f] = correlated(stored(merged_moments(moments(records, vector, F.col(f))), f"moments-{f}"))
    return kept


def bias_terms(records: DataFrame, filters: Sequence[BiasFilter], alpha: float, buckets: dict[str, Sequence[float]], vector: str = "vector", kept: Kept | None = None) -> DataFrame | None:
    """d, shift: what the filters add to the query vector. Categories by their delta; numbers by bucket deltas where the field has buckets, else by correlation. None if no filter applies.

    Kept statistics are used where there are any; else the records are aggregated."""
    kept = kept or Kept()
    out: DataFrame | None = None
    for f in filters:
        if f.field not in records.columns:
            continue
        if isinstance(f.value, str):
            part_sums = kept.sums.get(f.field)
            if part_sums is None:
                part_sums = sums(records.withColumn("_v", F.col(f.field).cast("string")).where(F.col("_v") == f.value), "_v", vector)
            all_ = kept.centroid if kept.centroid is not None else global_centroid(records, vector)
            own = centroids(part_sums.where(F.col("value") == f.value)).withColumnRenamed("c", "own")
            part = own.join(all_, "d").select("d", (alpha * (F.col("own") - F.col("c"))).alias("shift"))
        elif f.field in buckets:
            part_sums = kept.sums.get(f.field)
            if part_sums is None:
                part_sums = bucket_sums(records, f.field, buckets[f.field], vector)
            part = bucket_delta(part_sums, f, buckets[f.field]).select("d", (alpha * F.col("delta")).alias("shift"))
        else:
            middle = (float(f.value) + float(f.high)) / 2 if f.op == "range" else float(f.value)
            found = kept.correlations.get(f.field)
            part = (correlations(records, f.field, vector) if found is None else found).select("d", (alpha * F.col("r") * (F.lit(middle) - F.col("mean"))).alias("shift"))
        out = part if out is None else out.unionByName(part)
    return None if out is None else out.groupBy("d").agg(F.sum("shift").alias("shift"))


def biased(query: DataFrame, terms: DataFrame) -> DataFrame:
    """The query (one row: q, an array) shifted by terms (d, shift), as one row again."""
    q = query.select(F.posexplode("q").alias("d", "x"))
    moved = q.join(terms, "d", "left").select("d", (F.col("x").cast("double") + F.coalesce("shift", F.lit(0.0))).alias("x"))
    return moved.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("q"))
