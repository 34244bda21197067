"""Language identification by language-bitmask n-gram filters.

Of every language a Bloom filter holds the character n-grams that are typical of it. The filters share their hash
functions and are bit-sliced: cell i is a bitmask of the languages whose filter has bit i, so the AND of an n-gram's
``HASHES`` cells names all languages that contain it at once. A text's hits are summed per language and corrected for
false positives: a filter with a share f of its bits set answers yes to f**HASHES of the n-grams that it doesn't hold,
so of n n-grams with h hits (h - n p) / (1 - p) are true ones. The language with the most decides.

An n-gram is typical of a language if its share of the language's n-grams is at least ``TYPICAL`` of its largest share in
any language. Filters are learned from a bounded sample of labelled texts; texts are scored whole, a slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, ready, small, strings, whole

GRAMS = (2, 3, 4)
HASHES = 3
TYPICAL = 0.5
#: Texts of a language that its filter is learned from, about.
PER_LANGUAGE = 2000
UNKNOWN = "und"
#: Code points taken at a time.
SLICE = 1 << 18
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter, made once in a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    """The lower-cased text between two spaces, with a space for whatever is no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[points], points, np.uint32(32))


def grams(points: np.ndarray, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, hash) of the n-grams that start before ``last``, for each length: letters, with a space at either end at most."""
    letter = points != 32
    wide = points.astype(np.uint64) + np.uint64(1)
    for n in GRAMS:
        m = min(last, len(points) - n + 1)
        if m <= 0:
            continue
        fits = letter[:m] | letter[n - 1 : n - 1 + m] if n == 2 else letter[1 : 1 + m].copy()
        for k in range(2, n - 1):
            fits &= letter[k : k + m]
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h += wide[k : k + m] * _FACTORS[k]
        starts = np.flatnonzero(fits)
        h = h[starts]
        h ^= h >> np.uint64(32)
        h *= _FACTORS[0]
        h ^= h >> np.uint64(29)
        yield starts, h


def slices(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, list[int], list[int], int]]:
    """(code points, places of the texts in the batch, where each begins, end of starts): texts together, long ones in pieces."""
    over = max(GRAMS) - 1
    held, places, begins, size = [], [], [], 0
    for place, text in enumerate(texts):
        points = code_points(text)
        if size and size + len(points) > SLICE:
            yield np.concatenate(held), places, begins, size
            held, places, begins, size = [], [], [], 0
        if len(points) > SLICE:
            for at in range(0, len(points), SLICE):
                piece = points[at : at + SLICE + over]
                yield piece, [place], [0], min(SLICE, len(points) - at)
            continue
        held.append(points)
        places.append(place)
        begins.append(size)
        size += len(points)
    if held:
        yield np.concatenate(held), places, begins, size


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``cells`` (words, cells) of 64 languages a word."""

    languages: list[str]
    cells: np.ndarray

    def __post_init__(self) -> None:
        self.fill = np.array([float((self.cells[k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) for k in range(len(self.languages))])
        self.false = np.minimum(self.fill**HASHES, 0.999)
        narrow = np.uint8 if len(self.languages) <= 8 else np.uint16 if len(self.languages) <= 16 else np.uint32 if len(self.languages) <= 32 else np.uint64
        self.cells = self.cells.astype(narrow)

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """(words, n) bitmasks of the languages whose filters contain each n-gram."""
        size = np.uint64(self.cells.shape[1] - 1)
        step = hashes >> np.uint64(32) | np.uint64(1)
        found = self.cells[:, (hashes & size).astype(np.int64)]
        for j in range(1, HASHES):
            found &= self.cells[:, (hashes + np.uint64(j) * step & size).astype(np.int64)]
        return found

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected counts, and the n-grams of each text."""
        hits, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for points, places, begins, last in slices(iter(texts)):
            for starts, hashes in grams(points, last):
                if not len(starts):
                    continue
                bounds = np.searchsorted(starts, begins)
                ends = np.append(bounds[1:], len(starts))
                n[places] += ends - bounds
                masks = self.containing(hashes)
                for k in range(len(self.languages)):
                    sums = np.concatenate([[0], np.cumsum(masks[k // 64] >> masks.dtype.type(k % 64) & masks.dtype.type(1), dtype=np.int64)])
                    hits[places, k] += sums[ends] - sums[bounds]
        return np.maximum(0.0, (hits - n[:, None] * self.false) / (1 - self.false)), n


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of about ``per_language`` labelled texts of every language, those with the smallest hashes of their ids.

    Held-out rows and rows without an id or a language teach nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    counts = durable(known.groupBy("lang").count())
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(12)), 11) / F.lit(float(1 << 53))
    return known.join(small(counts, counts.count()), "lang").where(draw * F.col("count") < per_language).select("lang", "text")


def gram_counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, gram, n) of rows (lang, text), lang as its place in ``languages``; a task sends each n-gram of a language once or a few times."""
    place = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            langs = [place[x] for x in batch.column(0).to_pylist()]
            for lang in sorted(set(langs)):
                own = batch.column(1).filter(pa.array([x == lang for x in langs]))
                for points, _, _, last in slices(strings(own)):
                    for _, hashes in grams(points, last):
                        keys, n = np.unique(hashes, return_counts=True)
                        held.setdefault(lang, []).append((keys, n))
                        size += len(keys)
                    if size > 4_000_000:
                        held = {k: [merged(v)] for k, v in held.items()}
                        size = sum(len(v[0][0]) for v in held.values())
                        if size > 2_000_000:
                            yield from out()
                            held, size = {}, 0
        yield from out()

    return rows.mapInArrow(run, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE, least: int = 2) -> Filters | None:
    """Filters of the typical n-grams that a language's sample has at least ``least`` times; None without a labelled text."""
    spark = ready(docs.sparkSession)
    rows = durable(training_rows(docs, per_language))
    languages = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]  # the labels
    if not languages:
        return None
    counts = durable(gram_counts(rows, languages))
    total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals = spark.createDataFrame([(k, float(total.get(k, 1))) for k in range(len(languages))], "lang int, total double")
    rates = counts.join(F.broadcast(totals), "lang").select("gram", "lang", "n", (F.col("n") / F.col("total")).alias("rate"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "n", "rate")).alias("of"))  # a row a language
    typical = F.filter("of", lambda x: (x["n"] >= least) & (x["rate"] >= TYPICAL * F.col("best")))
    kept = durable(best.select("gram", F.explode(typical).alias("x")).select("gram", F.col("x.lang").alias("lang")))
    n = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    bits = int(min(26, max(12, np.ceil(np.log2(max(1, n) * 8)))))  # an eighth of a filter's bits a hash
    step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    cells = F.array(*((F.col("gram") + F.lit(j) * step).bitwiseAND(F.lit((1 << bits) - 1)) for j in range(HASHES)))
    bit = F.expr("shiftleft(1L, lang % 64)")
    words = -(-len(languages) // 64)
    table = np.zeros((words, 1 << bits), np.uint64)
    got = kept.select((F.col("lang") / 64).cast("int").alias("word"), bit.alias("bit"), F.explode(cells).alias("cell")).groupBy("word", "cell").agg(F.bit_or("bit").alias("mask")).toArrow()
    table[got.column("word").to_numpy(), got.column("cell").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)  # at most the filters' cells
    return Filters(languages, table)


def language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_grams) of every whole text.

    score is the language's share of all languages' corrected counts. Null texts and texts without a letter are ``und``
    with score 0; so is every text if no row teaches a language. Texts with letters but no known n-gram get the language
    with the most training texts and score 0; equal counts go to the one with more training texts, then by name. Rows are
    scored by their own text, so repeated and null ids are rows like others; a null id isn't held out and teaches
    nothing. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(learned(docs, per_language))  # cells for the n-grams of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                some = np.array([any(map(str.isalpha, t)) for t in texts])
                found, score, n = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                if filters is not None:
                    votes, n = filters.votes(texts)
                    best, total = votes.argmax(1), votes.sum(1)
                    found[some] = np.array(filters.languages, object)[best[some]]
                    score = np.where(some & (total > 0), votes[np.arange(len(texts)), best] / np.maximum(total, 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(score), pa.array(n.astype(np.int64))], ["id", "lang_pred", "score", "n_grams"])

    plain = docs.select(F.col("doc_id").cast("long").alias("id"), whole().alias("text"))
    out = plain.mapInArrow(run, "id long, lang_pred string, score double, n_grams long").withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_grams")
