"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Token weights of the cells are raked: scaled to each marginal
target in turn until all hold. Cells, targets and sweeps are DataFrames, so any number of levels is raked. A document's
sampling probability is its cell's calibrated weight over its tokens, scaled so that the largest is ``ceiling``;
documents are then kept by a fixed hash of their id and text.

Documents without a ``topic`` column get one from the whole text: the nearest of ``TOPICS`` centres of their words'
weights. Document frequencies and centres are fitted on all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, packed, ready, salted_lookup, sliced, small, stored, strings, whole

DIMENSIONS = ("source", "lang", "topic")
TOPICS, TOPIC_FEATURES, TOPIC_ROUNDS = 8, 1 << 10, 15
UNIT, SLICE, PIECE = float(1 << 20), 64, 1 << 18
#: Rounds end when no centre moves farther than this.
SETTLED = 1e-4
#: Centres that fewer of the texts are nearest to are no topics of their own.
TOPIC_SHARE = 0.02
REST = "*"
#: Default targets: token shares raised to this power.
POWER = 0.85
#: So many cells are raked in the driver; more of them by Spark, with the same result.
FEW_CELLS = 50_000


@dataclass
class Targets:
    """Wanted share of tokens by level of each dimension; levels that aren't named pool as ``*`` and share what is left."""

    shares: dict[str, dict[str, float]] = field(default_factory=dict)


def tokens() -> Column:
    """Words of the whole text."""
    return F.size(F.filter(F.split(whole(), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are letters, and the powers of an odd number and of its inverse."""
    odd = 0x9E3779B97F4A7C15
    powers = [np.multiply.accumulate(np.full(2 * PIECE + SLICE, x, np.uint64)) for x in (odd, pow(odd, -1, 1 << 64))]
    return np.array([chr(c).isalpha() for c in range(0x110000)]), *powers


def _pieces(column: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Texts with their rows, at most SLICE of them and 2 * PIECE characters at a time; longer texts are cut between words
    (within one, where it has over PIECE letters)."""
    rows, out, size = [], [], 0
    for row, text in enumerate(strings(column)):
        text = text.lower()
        while True:
            end = len(text)
            if end > PIECE:
                end = next((k for k in range(PIECE, 0, -1) if not text[k].isalpha()), PIECE)
            rows.append(row)
            out.append(text[:end])
            size += end
            if size >= PIECE or len(out) == SLICE:
                yield rows, out
                rows, out, size = [], [], 0
            text = text[end:]
            if not text:
                break
    if out:
        yield rows, out


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each run of letters: a hash of its code points, of all texts at once."""
    letters, power, inverse = _tables()
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters[code]
    edges = np.flatnonzero(np.diff(letter, prepend=False))
    start, end = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[: len(code)], dtype=np.uint64)])
    word = (sums[end] - sums[start]) * inverse[start]
    word = (word ^ (word >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.searchsorted(first, start, "right") - 1, (word >> np.uint64(32)).astype(np.int64) % TOPIC_FEATURES


def word_counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The lower-cased words of whole texts, counted by hash: ints ``count * TOPIC_FEATURES + feature``, for each piece of a text."""
    for column in texts:
        flat, each = [np.zeros(0, np.int32)], np.zeros(len(column) + 1, np.int64)
        for rows, pieces in _pieces(column):
            row, feature = _features(pieces)
            n = np.bincount(row * TOPIC_FEATURES + feature, minlength=len(pieces) * TOPIC_FEATURES)
            at = np.flatnonzero(n)
            flat.append((n[at] * TOPIC_FEATURES + at % TOPIC_FEATURES).astype(np.int32))
            np.add.at(each, np.array(rows) + 1, np.bincount(at // TOPIC_FEATURES, minlength=len(pieces)))
        offsets = (np.cumsum(each) * 4).astype(np.int32)
        yield pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(flat))])


def _dense(column: pa.Array) -> np.ndarray:
    """Counted words of some rows, by row and feature."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), np.int32)
    row = np.repeat(np.arange(len(rows)) * TOPIC_FEATURES, [len(r) // 4 for r in rows])
    counts = np.bincount(row + flat % TOPIC_FEATURES, flat // TOPIC_FEATURES, len(rows) * TOPIC_FEATURES)
    return counts.astype(float, copy=False).reshape(len(rows), TOPIC_FEATURES)  # without any word bincount() gives integers


def _units(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word weights of some rows as vectors of whole numbers of length UNIT, and which have words: sums and products of such
    numbers are exact, in any order."""
    x = _dense(column)
    x *= idf
    length = np.sqrt((x * x).sum(axis=1))
    some = length > 0
    x *= np.divide(UNIT, length, out=np.zeros_like(length), where=some)[:, None]
    return np.rint(x, out=x), some


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, the first of equals, and its squared distance less the vector's squared length."""
    d = (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The squared distance of each vector to the nearest centre."""
    return _nearest(x, centres)[1] + (x * x).sum(axis=1)


def _sums(counted: DataFrame, each: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Keys and whole numbers of all batches of ``_counts``, added up by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in sliced(batches, SLICE):
            for key, n in zip(*(x.tolist() for x in each(batch.column(0)))):
                total[key] = total.get(key, 0) + n
        yield pa.RecordBatch.from_pydict({"key": pa.array(total.keys(), pa.int64()), "n": pa.array(total.values(), pa.int64())})

    return {r["key"]: r["n"] for r in counted.select("_counts").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}


def _sizes_and_sums(counted: DataFrame, idf: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts with words are nearest to each centre, and the sums of their vectors."""
    k, width = len(centres), TOPIC_FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width), np.int64)
        for batch in sliced(batches, SLICE):
            x, some = _units(batch.column(0), idf)
            chosen = np.zeros((len(x), k))
            chosen[np.arange(len(x)), _nearest(x, centres)[0]] = some
            total[:, 1:] += (chosen.T @ x).astype(np.int64)
            total[:, 0] += chosen.sum(axis=0).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["key", "n"])

    out = np.zeros((k, width))
    for r in counted.select("_counts").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        out.ravel()[r["key"]] = r["n"]
    return out[:, 0], out[:, 1:]


def _candidates(counted: DataFrame, idf: np.ndarray, chosen: np.ndarray, most: int, turn: int) -> np.ndarray:
    """Up to ``most`` different texts' vectors, drawn with odds by their squared distance to the nearest chosen one.

    Each text runs a race whose time is drawn by its words' hash, at a speed of that distance; copies are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, float] = {}
        for batch in sliced(batches, SLICE):
            x, some = _units(batch.column(0), idf)
            far = _apart(x, chosen) if len(chosen) else np.ones(len(x))
            u = ((batch.column(1).to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
            at = np.flatnonzero((far > 0) & some)
            time = -np.log(u[at]) / far[at]
            for k in np.argsort(time)[: 4 * most]:
                best[batch.column(0)[int(at[k])].as_py()] = float(time[k])
            best = dict(sorted(best.items(), key=lambda b: (b[1], b[0]))[:most])
        yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.binary()), pa.array(best.values(), pa.float64())], ["_counts", "time"])

    drawn = counted.select("_counts", F.xxhash64("_counts", F.lit(turn)).alias("h")).mapInArrow(run, "_counts binary, time double")
    won = drawn.groupBy("_counts").agg(F.min("time").alias("time")).orderBy("time", "_counts").limit(most).select("_counts").collect()
    return _units(pa.array([bytes(r[0]) for r in won], pa.binary()), idf)[0]


def _first_centres(found: np.ndarray, sizes: np.ndarray, topics: int) -> np.ndarray:
    """``topics`` of the candidates: each next one is where the texts nearest to it lie farthest, in sum, from those chosen."""
    chosen = [int(sizes.argmax())]
    while len(chosen) < min(topics, len(found)):
        loss = sizes * _apart(found, found[chosen])
        left = [k for k in range(len(found)) if k not in chosen]
        chosen.append(max(left, key=lambda k: (loss[k], -k)))
    return found[chosen]


def topic_model(counted: DataFrame, topics: int = TOPICS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(idf, centres, topic of each centre): spherical k-means over the word weights of all rows of counted(_counts).

    Document frequencies, centres and their sizes are sums over every row, in whole numbers: the same however rows are
    dealt. Topics are numbered by size; a centre under TOPIC_SHARE of the texts is the topic of the nearest larger one.
    None if the texts are all alike, or there are none.
    """

    def frequencies(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = (_dense(column) > 0).sum(axis=0)  # -1 counts the rows
        return np.append(np.flatnonzero(n), -1), np.append(n[n > 0], len(column))

    seen = _sums(counted, frequencies)
    df = np.array([seen.get(f, 0) for f in range(TOPIC_FEATURES)])
    idf = np.log((seen.get(-1, 0) + 1) / (df + 1))
    found = _candidates(counted, idf, np.zeros((0, TOPIC_FEATURES)), 1, 0)
    for turn in (1, 2):
        found = np.concatenate([found, _candidates(counted, idf, found, 2 * topics, turn)])
    if len(found) < 2:
        return None
    centres = _first_centres(found, _sizes_and_sums(counted, idf, found)[0], topics)
    for _ in range(TOPIC_ROUNDS):
        sizes, sums = _sizes_and_sums(counted, idf, centres)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        moved = np.where(length > 0, np.rint(sums * np.divide(UNIT, length, out=np.zeros_like(length), where=length > 0)), centres)
        if np.sqrt(((moved - centres) ** 2).sum(axis=1)).max() <= SETTLED * UNIT:
            break
        centres = moved
    else:
        sizes, _ = _sizes_and_sums(counted, idf, centres)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    sizes, centres = sizes[order], centres[order]
    large = np.flatnonzero(sizes >= TOPIC_SHARE * sizes.sum())
    return idf, centres, large[_nearest(centres, centres[large])[0]]


def with_cells(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those to keep) with the struct column ``_cell`` (source, lang, topic, n_tokens); a missing
    level is ``unknown``. Texts without words have the largest topic."""
    keep = docs.columns if keep is None else keep
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in docs.columns else F.lit("unknown")
    cell = F.struct(level("source").alias("source"), level("lang").alias("lang"), level("topic").alias("topic"), tokens().alias("n_tokens"))
    if "topic" in docs.columns:
        return docs.select(*keep, cell.alias("_cell"))
    # texts are read once; the rounds of the model read the counts alone
    counts = F.arrow_udf(word_counts, "binary")
    rows = stored(docs.select(F.struct(*keep).alias("_row"), cell.alias("_cell"), counts(whole()).alias("_counts")), "topics")
    if (found := topic_model(rows)) is None:
        return rows.select("_row.*", "_cell")
    idf, centres, topic_of = found

    def named(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [column.slice(k, SLICE) for k in range(0, len(column), SLICE)]
            at = [_nearest(x, centres)[0] * some for x, some in (_units(p, idf) for p in parts)]
            yield pa.array([f"t{topic_of[k]}" for p in at for k in p], pa.string())

    return rows.select("_row.*", F.col("_cell").withField("topic", F.arrow_udf(named, "string")("_counts")).alias("_cell"))


def goals(cells: DataFrame, targets: Targets | None, power: float = POWER) -> dict[str, DataFrame]:
    """For each dimension its levels (level, pool, share): the levels of a pool share ``share`` in proportion to their tokens.

    Without targets every level is its own pool and wants its token share raised to ``power``, normalised. Targets of
    levels without tokens can't be served; their share goes to the others in proportion.
    """
    out = {}
    for d in DIMENSIONS:
        levels = cells.groupBy(F.col(d).alias("level")).agg(F.sum("t").alias("t"))
        if targets is None:
            pools = levels.select("level", F.col("level").alias("pool"), F.pow(F.col("t").cast("double"), F.lit(power)).alias("share"))
        else:
            named = targets.shares.get(d, {})
            left = max(0.0, named.get(REST, 1 - sum(v for k, v in named.items() if k != REST)))
            rows = [(str(k), max(0.0, float(v))) for k, v in named.items() if k != REST]
            wanted = cells.sparkSession.createDataFrame(rows, "level string, share double")
            pools = levels.join(wanted, "level", "left").select("level", F.when(F.col("share").isNotNull(), F.col("level")).otherwise(REST).alias("pool"), F.coalesce("share", F.lit(left)).alias("share"))
        one = pools.groupBy("pool").agg(F.first("share").alias("share"))
        total = one.agg(F.sum("share")).first()[0] or 0.0
        out[d] = durable(pools.drop("share").join(one, "pool").select("level", "pool", (F.col("share") / total if total > 0 else F.lit(None).cast("double")).alias("share")))
    return out


def rake(cells: DataFrame, goals: dict[str, DataFrame], sweeps: int = 60, close: float = 1e-6, few: int = FEW_CELLS) -> DataFrame:
    """cells(source, lang, topic, t) -> the same with ``w``, the cells' shares of all tokens scaled until the marginals hold.

    Each sweep is, for every dimension, a sum by pool and a lookup of the pool's factor. A dimension whose wanted
    shares are all zero is left as it is. Sweeps end when no marginal is off by more than ``close``, or when a sweep brings
    less than a hundredth of what is left (targets that the cells can't meet together). A counted number of cells up to
    ``few`` takes the same sweeps in the driver, as each is a job of Spark's for next to no work.
    """
    total, n = cells.agg(F.sum("t")).first()[0] or 1, cells.count()
    w = cells.select(*DIMENSIONS, "t", (F.col("t") / total).alias("w"))
    for d in DIMENSIONS:
        w = w.join(small(goals[d].select(F.col("level").alias(d), F.col("pool").alias(f"_{d}"), F.col("share").alias(f"_want_{d}")), n), d)
    w = durable(packed(w, n))
    if n <= few:
        return _raked(w, sweeps, close)
    last = float("inf")
    for _ in range(sweeps):
        off = []
        for d in DIMENSIONS:
            now = w.groupBy(f"_{d}").agg(F.sum("w").alias("_now"))
            w = w.join(small(now, n), f"_{d}").withColumn(f"_off_{d}", F.abs(F.col("_now") - F.coalesce(f"_want_{d}", "_now")))
            w = w.withColumn("w", F.when(F.col("_now") > 0, F.col("w") * F.coalesce(f"_want_{d}", "_now") / F.col("_now")).otherwise(F.lit(0.0))).drop("_now")
            off.append(F.max(f"_off_{d}"))
        w = durable(packed(w, n))
        worst = w.agg(F.greatest(*off).alias("worst")).first()["worst"]
        w = w.drop(*(f"_off_{d}" for d in DIMENSIONS))
        if worst is None or worst < close or worst > 0.99 * last:
            break
        last = worst
    return w.select(*DIMENSIONS, "t", "w")


def _raked(w: DataFrame, sweeps: int, close: float) -> DataFrame:
    """The sweeps of rake() over a few collected cells."""
    rows = sorted(w.collect(), key=lambda r: tuple(r[d] for d in DIMENSIONS))
    x = np.array([r["w"] for r in rows])
    codes, wants = [], []
    for d in DIMENSIONS:
        pools, code = np.unique([r[f"_{d}"] for r in rows], return_inverse=True) if rows else (np.zeros(0, str), np.zeros(0, int))
        want = np.full(len(pools), np.nan)
        want[code] = [np.nan if r[f"_want_{d}"] is None else r[f"_want_{d}"] for r in rows]
        codes.append(code)
        wants.append(want)
    last = float("inf")
    for _ in range(sweeps):
        worst = 0.0
        for code, want in zip(codes, wants):
            now = np.bincount(code, x, len(want))
            goal = np.where(np.isnan(want), now, want)
            worst = max(worst, float(np.abs(now - goal).max(initial=0.0)))
            x = x * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
        if worst < close or worst > 0.99 * last:
            break
        last = worst
    out = [(*(r[d] for d in DIMENSIONS), r["t"], float(v)) for r, v in zip(rows, x)]
    return w.sparkSession.createDataFrame(out, ", ".join(f"{d} string" for d in DIMENSIONS) + ", t long, w double")


def drawn(rows: DataFrame, targets: Targets | None, ceiling: float) -> DataFrame:
    """rows with ``_cell`` and ``_draw`` -> with ``_weight``, ``_probability`` and ``_kept``.

    The cells' table is looked up by salted keys, or broadcast where Spark finds it small enough: then rows stay in place.
    """
    cells = durable(rows.groupBy(*(F.col(f"_cell.{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("_cell.n_tokens").alias("t")).where("t > 0"))
    fitted = rake(cells, goals(cells, targets))
    total = cells.agg(F.sum("t")).first()[0] or 1
    fitted = durable(fitted.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), (F.col("w") * total / F.col("t")).alias("_weight")))
    top = fitted.agg(F.max("_weight")).first()[0] or 0.0
    fitted = fitted.withColumn("_probability", F.least(F.lit(1.0), F.col("_weight") * (ceiling / top if top > 0 else 0.0)))
    rows = rows.withColumns({f"_{d}": F.col(f"_cell.{d}") for d in DIMENSIONS})
    out = salted_lookup(rows, fitted, [f"_{d}" for d in DIMENSIONS], "_draw").drop(*(f"_{d}" for d in DIMENSIONS))
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("_weight", "_probability")}
    return out.withColumns(zero).withColumn("_kept", F.col("_draw") < F.col("_probability"))


def draw(seed: int = 7) -> Column:
    """An even number in [0, 1) from the id and the text, the same wherever and however often it is computed.

    Rows that repeat both share it; rows that share an id, or have none, don't.
    """
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), whole()), 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, targets: Targets | None = None, ceiling: float = 1.0, seed: int = 7) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, kept) of every row of docs.

    weight is the cell's target share over its share of the tokens, kept whether the row is in the sample. Documents
    without tokens have the weight of their cell, or 0 if all the cell's documents are empty. An empty table gives none.
    """
    ready(docs.sparkSession)
    taken = docs.select("doc_id", *(c for c in ("text", *DIMENSIONS) if c in docs.columns))
    rows = durable(with_cells(taken.withColumn("_draw", draw(seed)), ["doc_id", "_draw"]))
    out = drawn(rows, targets, ceiling)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "_cell.source", "_cell.lang", "_cell.topic", "_cell.n_tokens", F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


def sample(docs: DataFrame, targets: Targets | None = None, ceiling: float = 1.0, seed: int = 7) -> DataFrame:
    """The sampled rows with all their columns, each drawn by its own id and text."""
    ready(docs.sparkSession)
    rows = docs.select(F.struct(F.col("*")).alias("row"), "doc_id", *(c for c in ("text", *DIMENSIONS) if c in docs.columns))
    return drawn(with_cells(rows.withColumn("_draw", draw(seed)), ["row", "_draw"]), targets, ceiling).where("_kept").select("row.*")
