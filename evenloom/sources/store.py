"""Snapshots and caches by night: idempotent writes, merged caches, published documents with what is stale.

A night is a partition; writing it again replaces it and no other, so a run that failed halfway or is repeated leaves
one night. Caches of several writers are merged by the latest entry of each key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NIGHT = "night"


def write_night(rows: DataFrame, night: str, path: str, order: str | None = None) -> None:
    """Replace the partition of a night; other nights stay. A night without rows leaves what was there: publication gates decide that.

    ``order`` sorts within files, so that readers skip row groups by it.
    """
    out = rows.withColumn(NIGHT, F.lit(night).cast("date"))
    out = out.sortWithinPartitions(order) if order else out
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(NIGHT).parquet(path)


def read_nights(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The nights of a store, from ``first`` to ``last``: only their folders are read."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col(NIGHT) >= F.lit(first).cast("date")) if first else rows
    return rows.where(F.col(NIGHT) <= F.lit(last).cast("date")) if last else rows


def latest_night(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """The rows of the latest night, or of the latest up to ``before``."""
    rows = read_nights(spark, path, last=before)
    return rows.join(F.broadcast(rows.agg(F.max(NIGHT).alias(NIGHT))), NIGHT)  # one row


def merged_caches(*caches: DataFrame) -> DataFrame:
    """Caches (key, value, t, writer) -> one row a key, that of the latest ``t``; on ties of the last writer by name.

    An entry without a time loses against any other.
    """
    every = reduce(DataFrame.unionByName, caches)
    best = every.groupBy("key").agg(F.max_by(F.struct("value", "t", "writer"), F.struct(F.coalesce(F.col("t").cast("date"), F.lit("0001-01-01").cast("date")), F.coalesce("writer", F.lit("")))).alias("x"))
    return best.select("key", "x.*")


def pruned_cache(cache: DataFrame, used: DataFrame, today: str, days: int = 400) -> DataFrame:
    """cache(key, t, ...) without the keys that nothing uses any more and that were looked up over ``days`` days ago."""
    recent = F.coalesce(F.datediff(F.lit(today).cast("date"), F.col("t").cast("date")) <= days, F.lit(False))
    marked = cache.join(used.select("key").distinct().withColumn("used", F.lit(True)), "key", "left")
    return marked.where(recent | F.col("used").isNotNull()).drop("used")


def stale_map(verdicts: DataFrame) -> DataFrame:
    """verdicts(v, verdict, ok) -> (v, since): the venues whose items are kept from an older night."""
    return verdicts.where("verdict = 'houd'").select("v", F.col("ok").cast("date").alias("since"))


def published(events: DataFrame, venues: DataFrame, stale: DataFrame) -> DataFrame:
    """The rows of a published night: events with ``stale_since`` where their venue's items are kept, null else; only of known venues."""
    return events.join(venues.select("v").distinct(), "v", "left_semi").join(stale.select("v", F.col("since").alias("stale_since")), "v", "left")
