"""Tables of the engine: records in two tiers, a change log, cluster tables.

Base records are Parquet (Zstandard) partitioned by day, so a scan of days reads no other file; tracked metadata fields are columns of their own, so that
predicates reach the scan, and the rest stays in a JSON column. The hot tier is a small table that is merged at query time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import coldest, latest

VERSION = 1


def shredded(records: DataFrame, tracked: dict[str, str], metadata: str = "metadata") -> DataFrame:
    """tracked fields (name: SQL type) as columns from the JSON metadata; a value of another type is null, not converted."""
    v = F.try_parse_json(F.col(metadata))

    def typed(name: str, kind: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        text = kind == "string"
        fits = found == "STRING" if text else found == "BOOLEAN" if kind == "boolean" else found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")
        return F.when(fits, F.try_variant_get(v, f"$.{name}", kind))

    return records.withColumns({name: typed(name, kind) for name, kind in tracked.items()})


def checked(records: DataFrame, dim: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Records whose vector has dim finite numbers, and the others."""
    good = F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return records.where(good), records.where(~good)


def day_of(created: str) -> Column:
    """Days since 1970; 0 without a time."""
    return F.coalesce(F.floor(F.unix_timestamp(created) / 86400).cast("long"), F.lit(0))


def write_base(records: DataFrame, path: str, created: str = "created_at", mode: str = "append") -> None:
    """One directory a day; rows of a day are sorted by id, so that row groups prune point reads. mode "days" replaces the days that records have, and no others."""
    dealt = records.withColumn("day", day_of(created)).repartition("day", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("day", "id")
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if mode == "days" else dealt.write.mode(mode)
    writer.partitionBy("day").option("compression", "zstd").parquet(path)


def read_base(spark: SparkSession, path: str, days: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if days is None else df.where(F.col("day").isin([int(d) for d in days]))


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """day, records, files, bytes."""
    df = spark.read.parquet(path)
    files = df.select("day", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("day", "f").agg(F.count("*").alias("n"), F.max("b").alias("b"))
    return files.groupBy("day").agg(F.sum("n").alias("records"), F.count("*").alias("files"), F.sum("b").alias("bytes"))


def append_log(changes: DataFrame, path: str) -> None:
    """changes: txn_id, op (insert, update, delete), id and the record's columns."""
    changes.write.mode("append").parquet(path)


def replayed(log: DataFrame, checkpoint: int = 0) -> DataFrame:
    """The records after the log's entries from the checkpoint on: the last entry of an id decides."""
    return latest(log.where(F.col("txn_id") > checkpoint), op="op")


def upserted(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base with the changes (replayed) in place of rows of the same ids."""
    return base.join(changes.select("id"), "id", "left_anti").unionByName(changes.select(base.columns))


def demoted(hot: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The least used records over keep, which go to the base, and those that stay hot."""
    over = max(0, hot.count() - keep)
    return coldest(hot, over)


def promoted(base: DataFrame, days: Sequence[int]) -> DataFrame:
    """Days of the base held in memory, spilling to disk."""
    return base.where(F.col("day").isin([int(d) for d in days])).persist()


def save_clusters(clusters: DataFrame, path: str) -> None:
    clusters.withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(path)


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    other = df.where(F.col("version") != VERSION).select("version").first()
    if other:
        raise ValueError(f"clusters of version {other[0]}; this reads {VERSION}")
    return df.drop("version")


def readiness(spark: SparkSession, base: str | None, hot: DataFrame | None, clusters: DataFrame | None) -> dict[str, bool]:
    def there(path: str | None) -> bool:
        if not path:
            return False
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    return {"base": there(base), "hot": hot is not None, "clusters": clusters is not None}


__all__ = ["append_log", "checked", "demoted", "load_clusters", "partitions", "promoted", "read_base", "readiness", "replayed", "save_clusters", "shredded", "upserted", "write_base"]
