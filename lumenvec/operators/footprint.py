"""Personal footprints: a running blend of what a user has clicked and asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sums import group_sums

OLD, NEW = 0.7, 0.3


def step(old: Column, click: Column, query: Column) -> Column:
    """The first click starts from itself; each then blends 0.7 of the old with 0.3 of click times query."""
    return F.zip_with(F.coalesce(old, click), F.zip_with(click, query, lambda c, q: c * q), lambda o, p: o * F.lit(OLD) + p * F.lit(NEW))


#: A click that so many later ones of its user follow has a share under the smallest double: 0.7 ** LAST is 0.
LAST = 2_100


def footprints(clicks: DataFrame, user: str = "user_id", at: str = "ts") -> DataFrame:
    """user, footprint, n from clicks (user, at, click, query; vectors). Clicks are folded in the order of time, equal times by vector.

    The fold is linear: with i later clicks a click has the share NEW * OLD ** i of click times query, and the first OLD ** n of itself besides. So shares are
    added up by user and dimension with partial sums. A task passes on its LAST newest clicks of a user at most, as older shares are 0 in double arithmetic: no user's clicks come together."""
    own = clicks.select(F.col(user).alias("user"), F.struct(F.col(at).alias("t"), F.col("click").cast("array<double>").alias("c"), F.col("query").cast("array<double>").alias("q")).alias("e"))
    whole = own.groupBy("user").agg(F.count("*").alias("n"), F.min("e").alias("first"))
    newest = Window.partitionBy("user").orderBy(F.col("e").desc())
    recent = own.withColumn("i", F.row_number().over(newest)).where(F.col("i") <= LAST)
    share = lambda v, w: F.transform(v, lambda x: x * w)
    parts = recent.select("user", share(F.zip_with("e.c", "e.q", lambda c, q: c * q), F.lit(NEW) * F.pow(F.lit(OLD), F.col("i") - 1)).alias("p"))
    parts = parts.unionByName(whole.select("user", share(F.col("first.c"), F.pow(F.lit(OLD), F.col("n"))).alias("p")))
    summed = group_sums(parts, "p", F.col("user")).select(F.col("value").alias("user"), "d", "s")
    vectors = summed.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("footprint"))
    return vectors.join(whole.select("user", "n"), "user").select(F.col("user").alias(user), "footprint", "n")


def applied(query: Column, footprint: Column) -> Column:
    """The query through a footprint; without one it stays."""
    return F.when(footprint.isNull(), query.cast("array<double>")).otherwise(F.zip_with(query.cast("array<double>"), footprint, lambda q, f: q * f))
