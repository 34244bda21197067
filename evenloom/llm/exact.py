"""Exact deduplication by a tree-merge of sorted digest runs.

Each input partition makes a run: one row per distinct text it holds (digest, a second independent check, smallest
id, count), so a text repeated a million times leaves a partition as one row. Runs then meet in rounds: in every round
``fan_in`` neighbouring runs (2: binomial rounds) are sent to one parent, where their rows are merged and equal digests
fold into one row, until one run is left; Spark's shuffle has no merging reader, so a parent sorts the sorted runs that
it gets. A run is cut into digest ranges that travel separately, so no task ever holds a whole
run, and no round moves a text. Rows fold only if the SHA-256, the byte length and an independent XXH64 all agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, left_over, partitions, ready, rowed, salted_lookup, whole

RUN = "run long, digest binary, n_bytes long, check_sum long, keep_id long, group_size long"


def normalised(column: str = "text") -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(whole(column), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, text: Column, id_column: str = "doc_id") -> DataFrame:
    """(id, run, digest, n_bytes, check_sum) of every row; run is the input partition."""
    body = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("t"))
    return body.select("id", F.spark_partition_id().cast("long").alias("run"), F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("check_sum"))


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge rows sorted by (run, digest, n_bytes, check_sum): equal rows become one with the smallest id."""
    names = ["run", "digest", "n_bytes", "check_sum", "keep_id", "group_size"]
    rest: pa.Table | None = None

    def folded(t: pa.Table, firsts: np.ndarray) -> pa.RecordBatch:
        known = t.column("keep_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        smallest = np.minimum.reduceat(known, firsts)
        keep = pa.array(smallest, mask=smallest == np.iinfo(np.int64).max)
        heads = t.take(pa.array(firsts)).combine_chunks()
        counts = np.add.reduceat(t.column("group_size").to_numpy(), firsts)
        return pa.RecordBatch.from_arrays([*(heads.column(n).combine_chunks() for n in names[:4]), keep, pa.array(counts)], names)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not len(t):
            continue
        digest = t.column("digest").to_pylist()
        same = np.array([a == b for a, b in zip(digest[1:], digest)], bool)
        for n in ("run", "n_bytes", "check_sum"):
            v = t.column(n).to_numpy()
            same &= v[1:] == v[:-1]
        firsts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        rest = t.slice(int(firsts[-1])).combine_chunks()
        if len(firsts) > 1:
            yield folded(t.slice(0, int(firsts[-1])), firsts[:-1])
    if rest is not None and len(rest):
        yield folded(rest, np.array([0]))


def tree_merge(runs: DataFrame, n_runs: int, fan_in: int = 8) -> DataFrame:
    """Merge runs 0..n_runs-1 in rounds of ``fan_in`` until one is left; the work of a round is dealt by run and digest range."""
    n = partitions(runs.sparkSession)
    order = ["run", "digest", "n_bytes", "check_sum"]
    ranges = F.substring("digest", 1, 2)  # 65,536 ranges of digests
    while True:
        runs = runs.repartition(n, "run", ranges).sortWithinPartitions(*order).mapInArrow(merge_runs, RUN)
        if n_runs <= 1:
            return runs
        n_runs = -(-n_runs // fan_in)
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("long"))


def exact_groups(docs: DataFrame, text: Column | None = None, fan_in: int = 8, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Equal texts share keep_id, the smallest id among them; null texts count as empty. Of rows that repeat an id with
    the same text all are ``kept`` if that id is; a null id is kept only where its group has no other id, and its
    keep_id is then null. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    rows = durable(digests(docs, normalised() if text is None else text, id_column))
    key = ["digest", "n_bytes", "check_sum"]
    first = rows.groupBy("run", *key).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    first = first.select("run", *key, "keep_id", "group_size")
    merged = durable(tree_merge(first, max(1, rows.rdd.getNumPartitions()), fan_in).drop("run"))
    # a text of one row keeps itself; only the classes of several are looked up
    out = salted_lookup(rows.drop("run"), merged.where("group_size > 1"), key, "id", max(16, partitions(spark) // 4))
    alone = F.col("group_size").isNull()
    out = out.withColumns({"keep_id": F.when(alone, F.col("id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("id").isNull() & F.col("keep_id").isNull())
    return out.select(F.col("id").alias(id_column), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay: one of each group of equal texts, with all its columns.

    Rows are told apart by id and text, so that rows of one id with different texts don't decide for each other. The
    smallest id of a text stays, a null id only if there is no other; of rows that repeat an id with the same text the
    one whose columns come first as JSON.
    """
    key = F.sha2(normalised(), 256)
    found = durable(exact_groups(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"), "kept").groupBy("id", "key", "kept").agg(F.count("*").alias("rows")))
    return left_over(rowed(docs, key), found.where("not kept").select("id", "key"), found.where("kept and rows > 1").select("id", "key"))
