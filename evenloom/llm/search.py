"""Ranked lexical search over impact vectors in buckets of like length.

A document is a vector with an impact for each term, an item one with its terms' counts; the score is their inner
product, in whole numbers. Items are taken in blocks; a block's terms are the coordinates, and documents without any go.

- The documents are taken in the order of their vectors' lengths, longest first, in a few rounds whose sizes grow: after
  a round each item has a threshold, the score of its last place so far.
- Within a round, a task lays its rows out in buckets of vectors of like length. By Cauchy-Schwarz no vector of a bucket
  scores above the item's length times the bucket's greatest; items whose threshold is above that skip the bucket.
- Inside a bucket coordinates bound each vector: what the item's rare terms give, plus the product of both vectors'
  lengths over the common terms. Only vectors whose bound reaches the threshold are scored, exactly, in 64-bit integers.

Lengths are taken with the root of a term's weight on either side, which changes no product. Bounds are widened by
``SLACK``, so rounding never discards. Documents' texts are read once for each block of items; what is kept of them is a
few numbers for each of the block's terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, ready, strings, whole

TOP = 20
#: Items of a block, and bytes of their texts.
ITEMS, ITEM_BYTES = 1000, 16 << 20
BUCKET = 2048
#: Rounds end at these shares of all vectors.
ROUNDS = (1 / 64, 1 / 8, 1.0)
#: Terms in more than one document of so many are common. On sf0.1 bounds so made leave 0.7 % of the vectors at the final
#: thresholds and read 2.7 impacts for each; with 8, 34 % and 0.5; without common terms, 0.2 % and 4.4.
COMMON = 2
SLACK = 1 + 1e-9
_KEEP = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
FOLDED = bytes(ord(chr(b).lower()) if b < 0x80 and b in _KEEP else b if b in _KEEP else 0x20 for b in range(256))
PIECE = 1 << 20


def words(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, A-Z lower-cased, a piece of the text at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(FOLDED)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def counted(text: str, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of terms, the known ones as numbers in ascending order, how often each occurs)."""
    n, found = 0, []
    for piece in words(text):
        n += len(piece)
        found.append(np.array([k for k in map(vocabulary.get, piece) if k is not None], np.int32))
    terms, tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
    return n, terms, tf.astype(np.int32)


@dataclass
class Items:
    """A block of items: their ids, and for each its terms and counts; ``vocabulary`` numbers the block's terms."""

    ids: list[int | None]
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        for _, text in rows:
            for piece in words(text):
                for w in piece:
                    vocabulary.setdefault(w, len(vocabulary))
        found = [counted(text, vocabulary)[1:] for _, text in rows]
        return cls([i for i, _ in rows], [t for t, _ in found], [c.astype(np.int64) for _, c in found], vocabulary)


@dataclass
class Weights:
    """What scoring needs besides the vectors, by term."""

    weight: np.ndarray
    common: np.ndarray
    n_docs: int
    n_terms: int

    @classmethod
    def of(cls, df: np.ndarray, n_docs: int, n_terms: int) -> Weights:
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        return cls(weight, df * COMMON > n_docs, n_docs, n_terms)


def projected(docs: DataFrame, items: Items, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, terms, tf) of the documents with at least one term; terms and tf hold the block's only."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # a block's terms: at most ITEM_BYTES of text, or one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            got = [counted(t, vocabulary) for t in strings(batch.column(1))]
            cols = [pa.array([n for n, _, _ in got], pa.int64()), *(pa.array([g[k].tobytes() for g in got], pa.binary()) for k in (1, 2))]
            out = pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array([n > 0 for n, _, _ in got], pa.bool_()))

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole(text_column).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, terms binary, tf binary")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """In how many rows each of the block's terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df  # at most the block's terms
    return out


def vectors(rows: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, band, length, terms, impacts) of the rows with an impact above 0; the longest vectors have the highest bands."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        root = np.sqrt(w.weight)
        for batch in batches:
            terms, tf = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in ("terms", "tf"))
            n = batch.column("n").to_numpy()
            sizes = np.array([len(b) // 4 for b in batch.column("terms").to_pylist()], np.int64)
            m = 75 + 25 * n * w.n_docs // w.n_terms
            own = np.repeat(np.arange(len(n)), sizes)
            many = tf.astype(np.int64)
            impacts = w.weight[terms] * ((1_000_000_000 * many) // (1000 * many + 12 * m[own]))
            some = impacts > 0
            terms, impacts, own = terms[some], impacts[some], own[some]
            squares = np.bincount(own, (impacts / root[terms]) ** 2, len(n))
            cuts = np.searchsorted(own, np.arange(len(n) + 1))
            keep = np.flatnonzero(squares > 0)
            length = np.sqrt(squares[keep])
            band = np.floor(8 * np.log2(length)).astype(np.int32)
            packed = [pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in keep], pa.binary()) for x in (terms, impacts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep)), pa.array(band), pa.array(length), *packed], ["doc_id", "band", "length", "terms", "impacts"])

    return rows.mapInArrow(run, "doc_id long, band int, length double, terms binary, impacts binary")


class Bucket:
    """Vectors of like length."""

    def __init__(self, batch: pa.RecordBatch, weights: Weights):
        self.ids, self.length = batch.column("doc_id"), batch.column("length").to_numpy()
        packed = batch.column("terms").to_pylist()
        self.sizes = np.array([len(b) // 4 for b in packed], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.term = np.frombuffer(b"".join(packed), np.int32)
        self.impact = np.frombuffer(b"".join(batch.column("impacts").to_pylist()), np.int64)
        own = np.repeat(np.arange(len(packed)), self.sizes)
        common = weights.common[self.term]
        self.common = np.sqrt(np.bincount(own[common], self.impact[common].astype(float) ** 2 / weights.weight[self.term[common]], len(packed)))
        self.most_common = self.common.max(initial=0.0)
        rare = np.flatnonzero(~common)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.rare_term, self.rare_row, self.rare_impact = self.term[rare], own[rare], self.impact[rare].astype(float)

    def bounds(self, terms: np.ndarray, counts: np.ndarray, common_length: float) -> np.ndarray:
        """An upper bound of every vector's score; terms are the item's rare ones."""
        lo, hi = (np.searchsorted(self.rare_term, terms, side) for side in ("left", "right"))
        out = common_length * self.common
        for a, b, c in zip(lo.tolist(), hi.tolist(), counts.tolist()):
            if b > a:  # a term is in a row once
                out[self.rare_row[a:b]] += c * self.rare_impact[a:b]
        return out * SLACK

    def scores(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Exact scores of some vectors; counts holds the item's count of every term."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + sizes, sizes)
        return np.add.reduceat(self.impact[at] * counts[self.term[at]], ends - sizes)


class Best:
    """An item's highest scores so far in this task, and the score that a further vector has to reach."""

    def __init__(self, threshold: int, top: int):
        self.threshold, self.top = threshold, top
        self.score, self.id, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: pa.Array) -> None:
        self.score = np.concatenate([self.score, score])
        self.no_id = np.concatenate([self.no_id, ids.is_null().to_numpy(zero_copy_only=False)])
        self.id = np.concatenate([self.id, ids.fill_null(0).to_numpy()])
        first = np.lexsort((self.id, self.no_id, -self.score))[: self.top]
        self.score, self.id, self.no_id = self.score[first], self.id[first], self.no_id[first]
        if len(first) == self.top:
            self.threshold = max(self.threshold, int(self.score[-1]))


def searched(rows: DataFrame, items: Items, weights: Weights, thresholds: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best of rows that come longest first, for the items that can still gain."""
    shared = rows.sparkSession.sparkContext.broadcast((items.terms, items.counts, weights, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, w, least = shared.value
        squares = [c.astype(float) ** 2 * w.weight[t] for t, c in zip(terms, counts)]
        length = np.sqrt([s.sum() for s in squares])
        common_length = np.sqrt([s[w.common[t]].sum() for s, t in zip(squares, terms)])
        rare = [(t[~w.common[t]], c[~w.common[t]]) for t, c in zip(terms, counts)]
        best = [Best(int(x), top) for x in least]
        dense = np.zeros(len(w.weight), np.int64)
        for whole_batch in batches:
            for at in range(0, len(whole_batch), BUCKET):
                b = Bucket(whole_batch.slice(at, BUCKET), w)
                needs = np.array([max(1, x.threshold) for x in best])
                for k in np.flatnonzero(length * b.length.max() * SLACK >= needs):
                    bound = b.bounds(*rare[k], common_length[k])
                    alive = np.flatnonzero(bound >= max(1, best[k].threshold))
                    if not len(alive):
                        continue
                    dense[terms[k]] = counts[k]
                    score = b.scores(alive, dense)
                    dense[terms[k]] = 0
                    good = score >= max(1, best[k].threshold)
                    if good.any():
                        best[k].add(score[good], b.ids.take(pa.array(alive[good])))
        for k, x in enumerate(best):
            if len(x.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.score), k, np.int32)), pa.array(x.id, mask=x.no_id), pa.array(x.score)], ["item", "doc_id", "score"])

    return rows.select("doc_id", "length", "terms", "impacts").mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_block(docs: DataFrame, items: Items, top: int, id_column: str, text_column: str) -> DataFrame:
    """(item_id, rank, doc_id, score) for a block of items over all documents."""
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = durable(projected(docs, items, id_column, text_column))
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not items.vocabulary:
        return nothing
    weights = Weights.of(document_frequencies(rows, len(items.vocabulary)), n_docs, n_terms)
    ordered = durable(vectors(rows, weights).sortWithinPartitions(F.desc("length")))
    bands = sorted(((r.band, r["count"]) for r in ordered.groupBy("band").count().collect()), reverse=True)  # eight a doubling of the length
    total, best, thresholds, seen, high = sum(n for _, n in bands), None, np.zeros(len(items.ids), np.int64), 0, None
    goals = list(ROUNDS)
    for band, n in bands:
        seen += n
        high = band if high is None else high
        if seen < goals[0] * total:
            continue
        while goals and seen >= goals[0] * total:
            goals.pop(0)
        found = searched(ordered.where(F.col("band").between(band, high)), items, weights, thresholds, top)
        best = durable(ranked(found if best is None else found.unionByName(best.drop("rank")), top))
        for r in best.where(F.col("rank") == top).select("item", "score").collect():  # a row an item
            thresholds[r.item] = r.score
        high = None
    if best is None:
        return nothing
    ids = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` highest-scoring documents with a score above 0.

    Equal scores go by ascending id, a null id last. Rows are documents and items of their own, also where they repeat an
    id or a text: a repeated item has its rows once for each. Null and empty texts have no terms: such items find
    nothing, such documents aren't found nor counted. An empty table on either side gives no rows.
    """
    ready(docs.sparkSession)
    asked = durable(queries.select(F.col("item_id").cast("long").alias("item_id"), whole().alias("text"), F.monotonically_increasing_id().alias("place")))
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    out = None
    n_blocks = max(1, -(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    for k in range(n_blocks):
        rows = [(r.item_id, r.text) for r in asked.where(F.col("place") % n_blocks == k).collect()]
        found = search_block(docs, Items.of(rows), top, id_column, text_column)
        out = found if out is None else out.unionByName(found)
    return out
