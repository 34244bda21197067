"""Connected components by repeated contraction of the edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, durable, packed, small

MAX_ROUNDS = 60


def reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a few edges and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (differ := root[a] != root[b]).any():
        a, b = a[differ], b[differ]
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [[c.to_numpy() for c in b.columns] for b in batches]
    found = reached(*(np.concatenate([e[k] for e in edges] or [np.zeros(0, np.int64)]) for k in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "component"])


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, component) of a few edges(u, v), by one task."""
    return durable(edges.coalesce(1).mapInArrow(_settled, "node long, component long"))


def components(edges: DataFrame, few: int = SMALL_ROWS) -> DataFrame:
    """edges(u, v) of longs -> (node, component): component is the smallest node that can be reached.

    In every round each node hooks on to the neighbour (or itself) that comes first in a per-round pseudo-random
    order; hooked nodes merge and the edges between merged nodes go. Chains lose a constant share of their nodes a
    round and stars collapse at once, so the number of rounds is logarithmic; each is an aggregation and two lookups
    over the edges that are left, and the rounds' lookups are chained at the end. Lookup tables of a counted, small
    size are broadcast, larger ones joined. Self-loops, repeated edges and an empty edge list are allowed; rows with a
    null end are ignored.

    A counted number of edges up to ``few``, given or left by a round, is settled by one task, with the same result: rounds
    of Spark's are dozens of jobs and broadcasts for next to no work, and the driver's threads and plans for them cost more
    memory than the edges. So there are rounds for what is larger only.
    """
    edges = durable(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null").distinct())
    n = edges.count()
    if n <= few:
        return _at_once(edges)
    edges = packed(edges, n)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    left, found = edges.where("u <> v"), []
    for turn in range(MAX_ROUNDS):
        if n <= few:
            if n:
                found.append((_at_once(left).withColumnRenamed("component", "to"), 2 * n))
            break
        both = left.select("u", "v").union(left.select(F.col("v"), F.col("u")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("o"), F.col(c).alias("n"))
        hook = both.groupBy("u").agg(F.min(order("v")).alias("m")).select(F.col("u").alias("node"), F.least(F.col("m"), order("u"))["n"].alias("to"))
        hook = durable(packed(hook, 2 * n))
        size = hook.count()
        # a hooked node's target may itself be hooked: follow it once, the next rounds do the rest
        far = hook.join(small(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), size), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        found.append((far, size))
        side = lambda c: small(far.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")), size)  # noqa: B023, E731
        left = left.join(side("u"), "u").join(side("v"), "v").where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct()
        left = durable(packed(left, n))
        n = left.count()
        left = packed(left, n)
    else:
        if n:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = nodes.select("node", F.col("node").alias("root"))
    for k, (far, size) in enumerate(found):
        if k % 2 == 0:  # short plans: a long chain of lookups takes the optimizer more time than the lookups
            roots = durable(packed(roots, 2 * found[0][1]))
        roots = roots.join(small(far.select(F.col("node").alias("root"), "to"), size), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    roots = durable(packed(roots, 2 * found[0][1] if found else n))
    smallest = durable(roots.groupBy("root").agg(F.min("node").alias("component")))
    return roots.join(small(smallest, smallest.count()), "root").select("node", "component")
