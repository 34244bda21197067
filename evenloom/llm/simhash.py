"""SimHash near-duplicates with pivot distance tables.

A fingerprint summarises the word shingles of a text. To find all pairs of fingerprints within ``max_bits``, rows are
first dealt to buckets whose members agree on a group of bit blocks (pigeonhole: with ``blocks`` blocks and at most
``max_bits`` differing bits, ``blocks - max_bits`` blocks are untouched, so some bucket holds both). Inside a bucket
the Hamming distances to a fixed set of reference fingerprints (pivots) are tabulated; by the triangle inequality a
pair whose distances to any pivot differ by more than ``max_bits`` can't be near, so the largest coordinate difference
discards it unseen, and the survivors are verified. A bucket returns a spanning forest of its verified links, never
all pairs: the row count stays linear and the components are those of all links. Buckets above ``cap`` distinct
fingerprints are split in sub-blocks and every pair of sub-blocks is a group of its own.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import best_rows, durable, partitions, ready, salted_lookup, strings, text_key, whole
from .components import components

WORD, GAP = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
SEED = 42
PIVOTS = 24
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def word_pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, for about PIECE bytes of it at a time."""
    raw, at = text.encode("utf-8", "surrogatepass").lower(), 0  # bytes.lower() folds A-Z only
    while at < len(raw):
        gap = GAP.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        yield WORD.findall(raw, at, end)
        at = end


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of the whole sequence if it is shorter, and none without words."""
    digest, out, words = xxhash.xxh64_intdigest, [], []
    for piece in word_pieces(text):
        words += piece
        if len(words) < size:
            continue
        data = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends[:-1])]
        out.append(np.array([digest(data[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64))
        words = words[len(words) - size + 1 :]
    if not out and words:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def majorities(shingles: Iterable[np.ndarray], n: int, words: int, most: int = 1 << 15) -> np.ndarray:
    """(n, words) unsigned longs, a fingerprint for each array of hashes: a bit is 1 if set in over half of them. None: zero.

    Bits are unpacked for about ``most`` hashes at a time, also of one text.
    """
    out = np.zeros((n, words), np.uint64)
    pending: list[np.ndarray] = []
    rows: list[int] = []
    held = 0

    def packed(ones: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.packbits(ones * 2 > lengths[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]

    def bits_of(hashes: np.ndarray, k: int) -> np.ndarray:
        mixed = hashes if k == 0 else _remix(hashes, k)
        return np.unpackbits(np.ascontiguousarray(mixed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    def settle() -> None:
        nonlocal held
        if not rows:
            return
        lengths = np.array([len(x) for x in pending])
        hashes = np.concatenate(pending)
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for k in range(words):
            out[rows, k] = packed(np.add.reduceat(bits_of(hashes, k), firsts, axis=0, dtype=np.int32), lengths)
        pending.clear()
        rows.clear()
        held = 0

    def settle_long(i: int, hashes: np.ndarray) -> None:
        for k in range(words):
            ones = sum(bits_of(hashes[at : at + most], k).sum(axis=0, dtype=np.int64) for at in range(0, len(hashes), most))
            out[i, k] = packed(ones[None, :], np.array([len(hashes)]))[0]

    for i, found in enumerate(shingles):
        if len(found) > most:
            settle_long(i, found)
        elif len(found):
            pending.append(found)
            rows.append(i)
            held += len(found)
            if held > most:
                settle()
    settle()
    return out


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX[k])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[0])
    return h ^ (h >> np.uint64(32))


def fingerprint(docs: DataFrame, shingle: int = 3, words: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, f0..f<words-1>): the fingerprint of every whole text, 64 bits a word; a null text counts as empty."""
    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = majorities((shingle_hashes(t, shingle) for t in strings(batch.column(1))), len(batch), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(words))], ["id", *names])

    ready(docs.sparkSession)
    plain = docs.select(F.col(id_column).cast("long").alias("id"), whole(text_column).alias("text"))
    return plain.mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def block_tables(words: int, blocks: int, agree: int) -> list[np.ndarray]:
    """Bit positions of each table's key: every choice of ``agree`` of the ``blocks`` blocks."""
    parts = np.array_split(np.arange(64 * words), blocks)
    return [np.concatenate(x) for x in itertools.combinations(parts, agree)]


def pivots(words: int, count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, evenly random, the same on every executor."""
    return np.random.default_rng(20240229).integers(0, 1 << 64, (count, words), dtype=np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def links_in(key: np.ndarray, prints: np.ndarray, max_bits: int, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row numbers) among rows with equal, adjacent keys whose fingerprints are within ``max_bits``."""
    n = len(key)
    table = np.stack([distance(prints, p) for p in reference], axis=1) if n else np.zeros((0, len(reference)), np.int16)
    parent = np.arange(n)
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label = np.arange(n)
    at = np.arange(n)
    for lag in range(1, n):
        at = at[at + lag < n]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        i = at[label[at] != label[at + lag]]
        for k in range(0, len(reference), 4):  # discard by the largest coordinate difference, a few pivots at a time
            if len(i):
                i = i[np.abs(table[i, k : k + 4] - table[i + lag, k : k + 4]).max(axis=1) <= max_bits]
        i = i[distance(prints[i], prints[i + lag]) <= max_bits] if len(i) else i
        kept = []
        for x in i.tolist():
            a, b = find(x), find(x + lag)
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append(x)
        if kept:
            out_a.append(np.array(kept))
            out_b.append(np.array(kept) + lag)
            label = parent.copy()
            while (label != (step := label[label])).any():
                label = step
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


#: At most so many buckets are known to hold many rows.
MOST_LARGE = 1_000_000


def near_links(distinct: DataFrame, words: int, tables: list[np.ndarray], max_bits: int, cap: int = 4096) -> DataFrame:
    """distinct(id, f0..): one row per fingerprint -> links(u, v), a spanning forest of each bucket's near pairs."""
    names = [f"f{k}" for k in range(words)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(1 + k) for k in range(words)]
            prints = np.stack([c.to_numpy(zero_copy_only=False) for c in cols], axis=1).view(np.uint64) if len(batch) else np.zeros((0, words), np.uint64)
            bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
            for t, positions in enumerate(tables):
                packed = np.packbits(bits[:, positions], axis=1, bitorder="little")
                key = np.zeros((len(batch), 8), np.uint8)
                key[:, : packed.shape[1]] = packed
                key[:, 7] = t
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[:, 0]), batch.column(0), *cols], ["key", "id", *names])

    # keys have at most 56 bits; the top byte is the number of the table
    assert len(tables) <= 127 and all(len(x) <= 56 for x in tables)
    schema = ", ".join(f"{c} long" for c in ("key", "id", *names))
    return bucket_links(distinct.select("id", *names).mapInArrow(keyed, schema), words, max_bits, cap)


def bucket_links(rows: DataFrame, words: int, max_bits: int, cap: int = 4096) -> DataFrame:
    """rows(key, id, f0..) -> links(u, v), a spanning forest of the near pairs of each bucket of rows with one key.

    Buckets above ``cap`` rows, or above a millionth of all rows if that is more, are dealt in pairs of sub-blocks
    before anything is shuffled by the key; there are at most MOST_LARGE of them.
    """
    names = [f"f{k}" for k in range(words)]
    spark = rows.sparkSession

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = pivots(words)
        for t in whole_groups(batches, ("key", "part")):
            raw = [t.column(c).to_numpy() for c in ("key", "part")]
            change = np.concatenate([[False], (raw[0][1:] != raw[0][:-1]) | (raw[1][1:] != raw[1][:-1])])
            prints = np.stack([t.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            a, b = links_in(np.cumsum(change), prints, max_bits, reference)
            ids = t.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["u", "v"])

    sizes = durable(rows.groupBy("key").count().where(F.col("count") > cap))
    most = max(cap, -(-(sizes.agg(F.sum("count")).first()[0] or 0) // MOST_LARGE))
    # fewer than MOST_LARGE keys, as each has over a MOST_LARGE-th of the rows counted
    large = F.broadcast(sizes.where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(block_pairs())
    paired = rows.join(large, "key", "left").withColumn("own", own).withColumn("part", F.explode(parts))
    dealt = paired.repartition(partitions(spark), "key", "part").sortWithinPartitions("key", "part")
    return dealt.select("key", "part", "id", *names).mapInArrow(linked, "u long, v long")


def block_pairs() -> Column:
    """The numbers of the pairs of ``blocks`` sub-blocks that the sub-block ``own`` is part of."""
    pair = lambda x: 1 + F.least(F.col("own"), x) * F.lit(1 << 31).cast("long") + F.greatest(F.col("own"), x)
    return F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")), pair)


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by the columns ``names`` of longs."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not len(t):
            continue
        other = np.zeros(len(t), bool)
        for n in names:
            v = t.column(n).to_numpy()
            other |= v != v[-1]
        last = int(np.flatnonzero(other).max(initial=-1)) + 1
        rest = t.slice(last)
        if last:
            yield t.slice(0, last)
    if rest is not None and len(rest):
        yield rest


def near_groups(docs: DataFrame, shingle: int, words: int, tables: list[np.ndarray], max_bits: int, cap: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, f0.., component_id) of every row; component_id is the smallest id that links of near fingerprints reach.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take no part in a group's
    smallest id and get the component of their fingerprint (null if nobody else has it). An empty table gives none.
    """
    names = [f"f{k}" for k in range(words)]
    prints = durable(fingerprint(docs, shingle, words, id_column, text_column))
    distinct = durable(prints.groupBy(*names).agg(F.min("id").alias("id"), F.count("*").alias("rows")))
    links = near_links(distinct.where("id is not null").drop("rows"), words, tables, max_bits, cap)
    found = components(links)
    labels = distinct.join(found.withColumnRenamed("node", "id"), "id", "left")
    labels = labels.where("rows > 1 or component is not null").select(*names, F.coalesce("component", "id").alias("component_id"))
    # hot fingerprints are dealt over salts by the hash of the id; one of a single row without links is its own component
    out = salted_lookup(prints, labels, names, "id")
    return out.select(F.col("id").alias(id_column), *names, F.coalesce("component_id", "id").alias("component_id"))


def exact_tables(max_bits: int = 3, blocks: int = 5) -> list[np.ndarray]:
    return block_tables(1, blocks, blocks - max_bits)


def simhash_components(docs: DataFrame, max_bits: int = 3, blocks: int = 5, shingle: int = 3) -> DataFrame:
    """Every document's 64-bit fingerprint and the component of fingerprints linked at ``max_bits`` or fewer bits.

    ``blocks`` sets the key length (64 * (blocks - max_bits) / blocks bits): 5 keeps buckets small up to some 10^9
    distinct fingerprints, 6 beyond; the result is the same.
    """
    found = near_groups(docs, shingle, 1, exact_tables(max_bits, blocks), max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Keep one row of each near-duplicate group: texts linked by a Jaccard similarity of 0.8 or more of five-word shingles.

    No such pair is missed and no other links (see ``jaccard``). Rows are told apart by id and text; the smallest id of
    a group stays (a null id only if there is no other), then the smallest digest of the text. Extra columns are kept.
    """
    from .jaccard import near_sets

    ready(docs.sparkSession)
    return best_rows(docs, near_sets(docs.select(text_key().alias("text_key"), whole().alias("text"))), text_key())
