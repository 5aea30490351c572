"""Tables in the folder that all executors share, by which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one of the application, which only a local master can use."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir is unset: executors of {master} need a folder that all of them see")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lumenvec-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        where = "file://" + _own[app]
    return where.rstrip("/")


def folder(spark: SparkSession) -> str:
    """Of the application, in the shared one."""
    return f"{shared_dir(spark)}/lumenvec/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again. It cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        deleted(df.sparkSession, df._written_to)


def cleared(spark: SparkSession) -> None:
    """Delete all that the application has written, when its results are no longer read."""
    deleted(spark, folder(spark))


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with _part and _n (from 1): the order is that of _part, then of _n. Dealt by ranges, so no task orders more than its part."""
    parted = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    return parted.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))


__all__ = ["cleared", "deleted", "dropped", "folder", "in_order", "shared_dir", "written"]
