"""Streaming ingest: change batches into the log, the hot table and the statistics.

Each micro-batch is written under its number, so a batch that is run again after a failure replaces itself: writes are idempotent. Checkpoint and
source offsets are Spark's.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats
from ..operators.search import latest
from ..shared import deleted, dropped, written
from ..sources.store import day_of, read_base, write_base


def source(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def start(changes: DataFrame, root: str, categorical: tuple[str, ...] = (), vector: str = "vector", once: bool = True) -> StreamingQuery:
    """Writes root/hot/batch=N (records) and root/stats/batch=N (field, value, d, s, n: sums of the batch's rows, which add up)."""

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        try:
            df.write.mode("overwrite").parquet(f"{root}/hot/batch={n}")
            part = None
            for f in categorical:
                one = stats.sums(df.where(F.col("op") != "delete") if "op" in df.columns else df, f, vector).select(F.lit(f).alias("field"), F.col("value").cast("string").alias("value"), "d", "s", "n")
                part = one if part is None else part.unionByName(one)
            if part is not None:
                part.write.mode("overwrite").parquet(f"{root}/stats/batch={n}")
        finally:
            df.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def hot(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the hot table, as they came."""
    return spark.read.parquet(f"{root}/hot").drop("batch")


def current(spark: SparkSession, root: str, id_col: str = "id", order: str | None = None, op: str | None = None) -> DataFrame:
    """The hot table's records: of rows with equal ids that of the last batch (within it the last by order) stands; deleted ones (op) are left out."""
    df = spark.read.parquet(f"{root}/hot")
    at = F.struct("batch", *([order] if order else []))
    return latest(df.withColumn("_at", at), id_col, "_at", op).drop("_at", "batch")


def accepted(new: DataFrame, known: DataFrame, duplicates: str = "replace", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows to insert and rows that are refused. Rows whose id is known already replace it, or are refused (duplicates="refuse"), as are rows without id. Of rows with equal ids among the new ones, one is taken."""
    if duplicates not in ("replace", "refuse"):
        raise ValueError(f"duplicates: replace or refuse, not {duplicates}")
    good = new.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    if duplicates == "replace":
        return good, new.where(F.col(id_col).isNull())
    return good.join(known.select(id_col), id_col, "left_anti"), new.join(known.select(id_col), id_col, "left_semi").unionByName(new.where(F.col(id_col).isNull()))


def drain(spark: SparkSession, root: str, base: str, created: str = "created_at", order: str | None = None, op: str | None = None) -> int:
    """Move the hot table's records into the base and return how many; deleted ones leave it. Only days that hold old versions or get new ones are written again.

    Hot batches go when the base is written. If it is broken off between, both have the same records, and the next run does no harm. Not to be run while a stream writes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/hot")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = sorted(x.getPath().toString() for x in store.listStatus(path) if "batch=" in x.getPath().getName()) if store.exists(path) else []
    if not batches:
        return 0
    new = written(current(spark, root, order=order, op=op), "draining")
    try:
        old = read_base(spark, base)
    except AnalysisException:  # no base yet
        old = None
    if old is None:
        write_base(new, base, created)
    else:
        ids = spark.read.parquet(f"{root}/hot").select("id").distinct()
        day = day_of(created)
        days = [r[0] for r in old.join(ids, "id", "left_semi").select(F.col("day").cast("long")).union(new.select(day)).distinct().collect()]  # one row a day
        kept = old.where(F.col("day").isin(days)).join(ids, "id", "left_anti").drop("day")
        whole = written(kept.unionByName(new.select(kept.columns)), "days")  # the days are read and written
        write_base(whole, base, created, mode="days")
        for d in set(days) - {r[0] for r in whole.select(day).distinct().collect()}:
            deleted(spark, f"{base}/day={d}")
        dropped(whole)
    n = new.count()
    dropped(new)
    for b in batches:
        deleted(spark, b)
    return n


def statistics(spark: SparkSession, root: str, field: str) -> DataFrame:
    """value, d, s, n over all batches."""
    part = spark.read.parquet(f"{root}/stats").where(F.col("field") == field).select("value", "d", "s", "n")
    return stats.merged(part)


def windowed_counts(events: DataFrame, every: str = "60 seconds", late: str = "10 minutes", by: str = "user_id", at: str = "ts") -> DataFrame:
    """Requests in fixed windows, for rate limits; events later than the watermark are left out. For streams and tables."""
    return events.withWatermark(at, late).groupBy(F.window(at, every), by).agg(F.count("*").alias("n")) if events.isStreaming else events.groupBy(F.window(at, every), by).agg(F.count("*").alias("n"))


def live_footprints(clicks: DataFrame, user: str = "user_id") -> DataFrame:
    """(user_id, n, footprint) after each batch of a click stream (user, ts, click, query), by arbitrary state: one array a user."""
    import pandas as pd

    def fold(key, batches, state):
        footprint, n = (list(state.get[0]), state.get[1]) if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for c, q in zip(rows["click"], rows["query"], strict=True):
            old = list(c) if footprint is None else footprint
            footprint = [float(0.7 * o + 0.3 * x * y) for o, x, y in zip(old, c, q, strict=False)]
            n += 1
        state.update((footprint, n))
        yield pd.DataFrame({user: [key[0]], "n": [n], "footprint": [footprint]})

    return clicks.groupBy(user).applyInPandasWithState(fold, f"{user} bigint, n bigint, footprint array<double>", "footprint array<double>, n bigint", "update", "NoTimeout")
