"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package, and make sure that checkpoint() has a folder.

    On a cluster the package is installed or sent with ``spark.submit.pyFiles``, and ``spark.checkpoint.dir`` names a
    shared folder. Where that setting is absent, a temporary folder serves if one process on one machine is all there is,
    as in tests; on a cluster it is an error.
    """
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evenloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that losing an executor costs no earlier stage."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and reread: the size that the optimizer sees is the files', not a product of joins' sizes."""
    out = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


#: A table of so many narrow rows (some megabytes) may be broadcast.
SMALL_ROWS = 50_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table marked for broadcast if its counted ``rows`` are few; else left to a shuffled join."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def packed(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df of at most ``rows`` narrow rows in no more partitions than they need: what is nearly empty costs files and tasks."""
    return df.coalesce(max(1, min(partitions(df.sparkSession), -(-rows // each))))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(column: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def sliced(batches: Iterator[pa.RecordBatch], each: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, for what makes much of a row."""
    for batch in batches:
        for at in range(0, len(batch), each):
            yield batch.slice(at, each)


def strings(column: pa.Array, each: int = 256) -> Iterator[str]:
    """The values of a column of texts, a few at a time: a batch may hold many megabytes."""
    for at in range(0, len(column), each):
        yield from column.slice(at, each).to_pylist()


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], salt_from: str | Column, salts: int = 16) -> DataFrame:
    """Left join against ``right``, which has one row per key, where one key may hold a large part of ``left``.

    Every row of ``right`` is repeated for each salt and the rows of a key are dealt over the salts, so that no task
    gets more than 1/salts of a key. Null keys match nothing.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*keys, "_salt"], "left").drop("_salt")


def text_key() -> Column:
    """SHA-256 of the text: with the id, what tells rows apart."""
    return F.unhex(F.sha2(whole(), 256))


def rowed(docs: DataFrame, key: Column, *others: str) -> DataFrame:
    """(row, id, key, others): whole rows in one column, beside their id and key, so that no name of theirs can clash."""
    return docs.select(F.struct(F.col("*")).alias("row"), F.col("doc_id").alias("id"), key.alias("key"), *others)


def best_rows(docs: DataFrame, groups: DataFrame, key: Column) -> DataFrame:
    """One row of docs for each group of groups(text_key, group), which has one row per ``key`` of docs.

    The smallest id stays (a null id only if there is no other), then the smallest key; of rows that share both, the
    one whose other columns come first as JSON. All columns are kept.
    """
    rows = docs.select(F.col("doc_id").alias("id"), key.alias("text_key")).groupBy("id", "text_key").count()
    rows = durable(salted_lookup(rows, groups, ["text_key"], "id"))
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "text_key")).alias("best"), F.count("*").alias("n"))
    several = salted_lookup(rows.drop("count"), best.where("n > 1"), ["group"], "text_key").where("best is not null")
    gone = several.where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key")))).select("id", F.col("text_key").alias("key"))
    return left_over(rowed(docs, key), gone, rows.where("count > 1").select("id", F.col("text_key").alias("key")))


def left_over(rows: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of rows(row, id, key), as they were before rowed(), whose (id, key) isn't in ``gone``; of those in
    ``repeated`` the one whose columns come first as JSON."""
    gone, repeated = durable(gone), durable(repeated)
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))
    left = rows.alias("r").join(small(gone, gone.count()).alias("g"), same("r", "g"), "left_anti")
    n = repeated.count()
    if not n:
        return left.select("row.*")
    repeated = small(repeated, n).alias("d")
    one = left.alias("r").join(repeated, same("r", "d"), "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.alias("r").join(repeated, same("r", "d"), "left_anti").select("row").union(one.select("row")).select("row.*")
