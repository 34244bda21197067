"""Quality classifier from weak labels.

Overlapping heuristic labellers each call a text good or bad or abstain. Expectation-maximisation over the counts of
their vote patterns (all documents; at most 4^labellers patterns, in practice some hundreds, however many documents) estimates how often each
labeller votes how on good and on bad texts, and the class each pattern belongs to. Those posterior labels then train
a linear scorer over hashed word shapes, which scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ready, strings, whole

BUCKETS = 1 << 12
MEMO = 100_000
SYMBOLS = "#$%&*|{}<>@\\^~=_"
#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = frozenset("the of and to in a is that it for was on as with be by this are at an from de la le et les un une des du que der die und das den von zu mit el los las y en es se por con para il che non per".split())
LABELLERS = ("symbols", "capitals", "exclamations", "repeats", "pairs", "redundancy", "bars", "word_length", "sentences", "length", "function_words")
VOTE = {"1": 1, "0": 0, "-": -1, ".": -2}
MARKS = {v: c for c, v in VOTE.items()}
_UPPER, _RUN = bytes(range(65, 91)), re.compile(r"(.)\1+", re.S)


def votes(text: str) -> list[int]:
    """1 good, 0 bad, -1 abstains, -2 can't judge a text as short as this; in the order of LABELLERS."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [-2] * len(LABELLERS)
    band = lambda x, good, bad: 1 if x <= good else 0 if x >= bad else -1
    raw = text.encode("utf-8", "surrogatepass")
    letters = max(1, len(raw) - len(raw.translate(None, bytes(range(65, 91)) + bytes(range(97, 123)))))
    upper = (len(raw) - len(raw.translate(None, _UPPER))) / letters
    again = sum(map(str.__eq__, words, words[1:])) / n
    stops = sum(text.count(c) for c in ".?!;:") / n
    common = sum(w in FUNCTION_WORDS for w in map(str.lower, words)) / n
    return [
        band(sum(text.count(c) for c in SYMBOLS) / chars, 0.01, 0.04),
        band(upper, 0.12, 0.4),
        0 if text.count("!!") / n > 0.1 else -1,
        band(again, 0.03, 0.2) if n >= 8 else -2,
        band(1 - len(set(zip(words, words[1:]))) / (n - 1), 0.1, 0.35) if n >= 12 else -2,
        band(-len(zlib.compress(raw, 1)) / len(raw), -0.3, -0.2) if n >= 40 else -2,
        0 if text.count("|") / n > 0.1 else -1,
        1 if 3 <= len(text) / n - 1 <= 9 else 0 if len(text) / n - 1 < 2 or len(text) / n - 1 > 14 else -1,
        (1 if 1 / 60 <= stops <= 1 / 3 else 0 if stops > 1 or stops < 1 / 400 else -1) if n >= 12 else -2,
        1 if n >= 20 else -2,
        (1 if common >= 0.08 else 0 if common < 0.01 else -1) if n >= 12 else -2,
    ]


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM. patterns: (k, labellers) votes -> (posterior of good for each, P(vote | class)[class, labeller, vote], class shares)."""
    code = np.maximum(patterns, -1) + 1
    judged = patterns > -2
    good, bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    post = (good + 0.5) / (good + bad + 1)
    post = np.where(bad >= 2, np.minimum(post, 0.3), post)  # a text with two faults starts as bad
    weight = counts.astype(float)
    likely = np.full((2, patterns.shape[1], 3), 1 / 3)
    share = np.array([0.5, 0.5])
    for _ in range(steps):
        for c, p in ((0, 1 - post), (1, post)):
            share[c] = (weight * p).sum() + 1
            for j in range(patterns.shape[1]):
                seen = np.bincount(code[:, j], weight * p * judged[:, j], 3) + 1
                likely[c, j] = seen / seen.sum()
        share = share / share.sum()
        logs = [np.log(share[c]) + (np.log(likely[c][np.arange(patterns.shape[1]), code]) * judged).sum(1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, likely, share


def shape_bucket(word: str) -> int:
    """The bucket of a word's shape: kinds of characters with runs shortened, and its length's class."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return xxhash.xxh32_intdigest(f"{_RUN.sub(r'\1', kinds)}:{min(len(word), 30) // 4}") % (BUCKETS - 1)


def bucket_list(text: str, memo: dict[str, int]) -> np.ndarray:
    """A bucket for each word; the last bucket for a word that repeats the one before it."""
    words = text.split()
    if len(memo) > MEMO:
        memo.clear()
    out = []
    for w in words:
        b = memo.get(w)
        if b is None:
            b = memo[w] = shape_bucket(w)
        out.append(b)
    got = np.array(out, np.int64)
    if len(words) > 1:
        got = np.concatenate([got, np.full(sum(map(str.__eq__, words, words[1:])), BUCKETS - 1)])
    return got


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; rows are (buckets, counts)."""
    if not rows:
        return np.zeros(BUCKETS), 0.0
    col = np.concatenate([b for b, _ in rows])
    val = np.concatenate([values(c) for _, c in rows])
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    w, b = np.zeros(BUCKETS), 0.0
    ahead, ahead_b = w.copy(), b
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * ahead[col], len(rows)) + ahead_b, -30, 30)))
        g = (p - labels) / len(rows)
        new = ahead - 2.0 * (np.bincount(col, val * g[row], BUCKETS) + l2 * ahead)
        new_b = ahead_b - 2.0 * g.sum()
        ahead, ahead_b = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def values(counts: np.ndarray) -> np.ndarray:
    """A row's feature values: the roots of its buckets' shares."""
    return np.sqrt(counts / max(1, counts.sum()))


def scored(buckets: np.ndarray, counts: np.ndarray, w: np.ndarray, b: float, prior: float) -> float:
    """The probability of a good text; the prior if it has no words."""
    if not len(buckets):
        return prior
    return float(1 / (1 + np.exp(-np.clip((w[buckets] * values(counts)).sum() + b, -30, 30))))


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> (id, pattern, buckets, counts): the votes, and the word shapes as packed numbers."""
    memo: dict[str, int] = {}
    for batch in batches:
        found, patterns = [], []
        for t in strings(batch.column(1)):
            found.append(np.unique(bucket_list(t, memo), return_counts=True))
            patterns.append("".join(MARKS[v] for v in votes(t)))
        cols = [pa.array([x.astype(kind).tobytes() for x in xs], pa.binary()) for xs, kind in (([b for b, _ in found], np.int16), ([c for _, c in found], np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns, pa.string()), *cols], ["id", "pattern", "buckets", "counts"])


def unpacked(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(buckets, np.int16).astype(np.int64), np.frombuffer(counts, np.int32).astype(np.int64)


def quality(docs: DataFrame, max_rows: int = 8000) -> DataFrame:
    """(doc_id, score, keep, n_good, n_bad) of every row, by its own text.

    score is the probability of a good text, keep whether it is at least 0.5, n_good and n_bad the labellers' votes.
    The scorer is fitted on at most ``max_rows`` rows, those with the smallest hashes of id and description (equal ones
    are alike); the labellers on all. Rows that repeat an id, and null ids, are rows like others. Null and empty texts
    have no words, no votes and the prior's score. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), whole().alias("text"))
    rows = durable(plain.mapInArrow(describe, "id long, pattern string, buckets binary, counts binary"))  # texts are read once
    counted = sorted((r.pattern, r["count"]) for r in rows.groupBy("pattern").count().collect())  # some hundreds of rows: votes depend on each other
    if not counted:
        return plain.selectExpr("id as doc_id", "0d as score", "true as keep", "0 as n_good", "0 as n_bad")
    table = np.array([[VOTE[c] for c in p] for p, _ in counted])
    post, _, share = fit_labellers(table, np.array([n for _, n in counted]))
    label = {p: float(x) for (p, _), x in zip(counted, post)}

    sample = rows.orderBy(F.xxhash64("id", "pattern", "buckets", "counts"), "id", "pattern", "buckets", "counts").limit(max_rows).collect()
    w, b = fit_scorer([unpacked(r.buckets, r.counts) for r in sample], np.array([label[r.pattern] for r in sample]))
    shared = spark.sparkContext.broadcast((w, b, float(share[1])))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [scored(*unpacked(x, c), *shared.value) for x, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["id", "pattern", "score"])

    count = lambda c: (F.length("pattern") - F.length(F.replace("pattern", F.lit(c), F.lit("")))).cast("int")
    return rows.mapInArrow(run, "id long, pattern string, score double").select(F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).alias("keep"), count("1").alias("n_good"), count("0").alias("n_bad"))
