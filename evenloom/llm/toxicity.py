"""Toxicity classifier with counterfactual regularisation.

A logistic model over hashed features (each distinct word and its leading characters, present or not) is fitted on
labelled rows by proximal gradient steps with an L1 term, so that words without evidence weigh nothing and long texts
don't drift. For labelled texts that mention an identity term, copies with the term swapped for others of its group are
made, and the squared change of the raw score between a text and its copies is added to the loss: a neutral mention
can't make a text look toxic, however the labels are distributed over groups.

Groups are those of IDENTITY_TERMS, which a caller may replace, and those mined from the training rows: words that many
rows mention and whose rows are toxic about as often as others (``mentions``) may stand for each other. A copy is kept
as its difference from its text, the few features that go and come, so equal swaps of many texts travel once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, ready, strings, whole

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
BUCKETS = 1 << 18
#: Groups of terms that may be exchanged without changing whether a sentence is toxic.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("mother", "father"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"), ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"), ("immigrant", "refugee", "foreigner", "native"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
PREFIXES = range(3, 9)
MEMO = 100_000


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its leading 3 to 8 characters."""
    names = [f"w:{word}", *(f"p:{word[:k]}" for k in PREFIXES if k <= len(word))]
    return [xxhash.xxh32_intdigest(n) % BUCKETS for n in names]


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(words: set[str]) -> np.ndarray:
    return np.array(sorted({f for w in words for f in word_features(w)}), np.int32)


def swaps(words: set[str], groups: dict[str, tuple[str, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features that go, features that come) of a copy for each other term of the groups that the words mention."""
    held = Counter(f for w in words for f in set(word_features(w)))
    out = []
    for term in sorted(words & groups.keys()):
        for other in groups[term]:
            if other != term and other not in words:
                old, new = set(word_features(term)), set(word_features(other))
                gone = {f for f in old - new if held[f] == 1}
                out.append((np.array(sorted(gone), np.int32), np.array(sorted(f for f in new - old if not held[f]), np.int32)))
    return out


class Sparse:
    """Rows of present features, in one array; products take ``CHUNK`` entries at a time."""

    CHUNK = 1 << 20

    def __init__(self, rows: list[np.ndarray], place: np.ndarray, n: int):
        """place: the column of each feature of the rows, or -1 if it has none. Rows are copied one by one, as the driver holds them all."""
        self.n = n
        self.counts = np.array([np.count_nonzero(place[r] >= 0) for r in rows], np.int64)
        self.col = np.empty(self.counts.sum(), np.int32)
        at = 0
        for r, k in zip(rows, self.counts.tolist()):
            own = place[r]
            self.col[at : at + k] = own[own >= 0]
            at += k
        ends = np.cumsum(self.counts)
        cuts = [0, *np.unique(np.searchsorted(ends, np.arange(self.CHUNK, len(self.col) + self.CHUNK, self.CHUNK)) + 1).tolist()]
        bounds = [min(x, len(rows)) for x in cuts]
        self.parts = [(i, j, int(ends[i] - self.counts[i]), int(ends[j - 1])) for i, j in zip(bounds, bounds[1:]) if j > i]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.counts))
        for i, j, a, b in self.parts:
            own = np.repeat(np.arange(j - i), self.counts[i:j])
            out[i:j] = np.bincount(own, w[self.col[a:b]], j - i)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for i, j, a, b in self.parts:
            out += np.bincount(self.col[a:b], np.repeat(g[i:j], self.counts[i:j]), self.n)
        return out


def fit(rows: list[np.ndarray], labels: list[int], pairs: list[tuple[np.ndarray, np.ndarray, int]], balance: float = 1.0, l1: float = 6e-4, steps: int = 120, least: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias. pairs: features that a swap takes and gives, and how many texts it was made of; ``balance`` weighs
    the mean square of the changes of the raw score."""
    seen = np.zeros(BUCKETS, np.int64)
    for r in rows:
        seen[r] += 1
    usable = seen >= least
    for _, new, _ in pairs:  # a swapped-in term must be able to receive weight, or there is nothing to balance
        usable[new] |= seen[new] > 0
    place = np.full(BUCKETS, -1, np.int32)
    ids = np.flatnonzero(usable)
    place[ids] = np.arange(len(ids))
    x = Sparse(rows, place, len(ids))
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS), float(-4 if not len(y) or y.max() == 0 else 4)
    left, right = (Sparse([p[k] for p in pairs], place, len(ids)) for k in (0, 1))
    share = np.array([n for _, _, n in pairs], float)
    share = balance * share / share.sum() if pairs else share
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both classes count alike
    w, b = np.zeros(len(ids)), 0.0
    ahead, ahead_b, t = w.copy(), b, 1.0
    scale = x.back(weight * np.maximum(x.counts, 1)) * 0.25  # per-feature step sizes: a diagonal bound on the curvature
    if pairs:
        both = 2 * share * np.maximum(left.counts + right.counts, 1)
        scale += left.back(both) + right.back(both)
    rate = 1 / np.maximum(scale, 1e-6)
    bias_rate = 1.0 / 0.25 / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(ahead) + ahead_b, -30, 30)))
        g = weight * (p - y)
        grad = x.back(g)
        if pairs:
            change = 2 * share * (left.dot(ahead) - right.dot(ahead))
            grad += left.back(change) - right.back(change)
        new = ahead - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_b = ahead_b - bias_rate * g.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((ahead - new) * (new - w)).sum() > 0:
            t_next = 1.0  # restart the momentum when it points uphill
        ahead, ahead_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    out = np.zeros(BUCKETS)
    out[ids] = w
    return out, float(b)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """(toxic, text) of at most ``max_rows`` labelled documents with crc32(doc_id as text) mod 5 not 0.

    The sample is the labelled ids with the smallest hashes, so it is the same in every run. Labels that are null are
    no labels; an id with several labels has the largest, one with several rows the text with the smallest hash.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = ready(docs.sparkSession).createDataFrame([(r.doc_id, r.toxic) for r in known.collect()], "doc_id long, toxic int")
    # at most max_rows small rows, by the limit above
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).join(F.broadcast(sample), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), F.sha2("text", 256))).alias("text")).select("toxic", "text")


def mentions(rows: DataFrame, share: float = 0.02, most_z: float = 1.5, size: int = 4) -> list[tuple[str, ...]]:
    """Groups of ``size`` words that may stand for each other, from training rows (toxic, text).

    They are words of three letters or more that at least ``share`` of the rows have and whose rows are toxic as often
    as all are, within ``most_z`` standard errors: mentions that say nothing about toxicity. Words of about the same
    frequency make a group. There are at most a row's average number of words over ``share`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[w for w in distinct_words(t) if len(w) >= 3] for t in strings(batch.column(1))]
            each = [y for y, ws in zip(batch.column(0).to_pylist(), words) for _ in ws]
            yield pa.RecordBatch.from_arrays([pa.array([w for ws in words for w in ws], pa.string()), pa.array(each, pa.int32())], ["word", "toxic"])

    ready(rows.sparkSession)
    n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic or toxic == n:
        return []
    rate = toxic / n
    counted = rows.select("toxic", "text").mapInArrow(run, "word string, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= share * n)
    off = F.abs(F.col("t") / F.col("n") - rate) * F.sqrt("n") / (rate * (1 - rate)) ** 0.5
    words = [r.word for r in counted.where(off <= most_z).orderBy(F.desc("n"), "word").collect()]
    return [tuple(words[k : k + size]) for k in range(0, len(words) - 1, size)]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, balance: float = 1.0, identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> tuple[np.ndarray, float]:
    """Fit on training_rows(); the groups to swap are ``identity_terms`` and the mined mentions()."""
    ready(docs.sparkSession)
    rows = durable(training_rows(docs, labels, max_rows))
    groups = {term: group for group in (*mentions(rows), *identity_terms) for term in group}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(distinct_words(t)).tobytes() for t in strings(batch.column(1))], pa.binary())], ["toxic", "features"])

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for t in batch.column(1).to_pylist() for x in swaps(distinct_words(t), groups)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)], ["old", "new"])

    texts = rows.mapInArrow(described, "toxic int, features binary").toArrow()  # at most max_rows
    # pairs of terms, and the few ways in which their features may overlap with a text's other words
    pairs = rows.mapInArrow(swapped, "old binary, new binary").groupBy("old", "new").count().toArrow()
    texts, pairs = _in_order(texts, "toxic", "features"), _in_order(pairs, "old", "new", "count")
    model = fit(_buckets(texts, "features"), texts["toxic"].to_pylist(), list(zip(_buckets(pairs, "old"), _buckets(pairs, "new"), pairs["count"].to_pylist())), balance)
    del texts, pairs
    pa.default_memory_pool().release_unused()
    return model


def _in_order(table: pa.Table, *columns: str) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in columns]).combine_chunks()


def _buckets(table: pa.Table, column: str) -> list[np.ndarray]:
    """The features of each row, as views of the table's own memory."""
    if not len(table):
        return []
    values = table[column].chunk(0).cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] // 4
    flat = np.frombuffer(values.buffers()[2], np.int32, int(ends[-1]))
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def score_column(spark: SparkSession, model: tuple[np.ndarray, float]) -> Callable[[Column], Column]:
    """A function from a text column to its score; null and empty texts get the score of no words."""
    weights, bias = model
    shared = ready(spark).sparkContext.broadcast((np.asarray(weights, np.float32), bias))  # BUCKETS numbers

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, b = shared.value
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in strings(batch):
                used: set[int] = set()
                if len(memo) > MEMO:
                    memo.clear()
                for word in distinct_words(text or ""):
                    got = memo.get(word)
                    if got is None:
                        got = memo[word] = tuple(f for f in word_features(word) if w[f])
                    if got:
                        used.update(got)
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, b + sum(float(w[f]) for f in sorted(used)))))))
            yield pa.array(out, pa.float64())

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, balance: float = 1.0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; a null id is not held out."""
    score = score_column(docs.sparkSession, train(docs, labels, max_rows, balance))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """The rows that the classifier doesn't reject, with all their columns; each row by its own text."""
    score = score_column(docs.sparkSession, train(docs, labels, max_rows))
    return docs.where(score(F.col("text")) < 0.5)
