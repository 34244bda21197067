"""Vector code compression: product codes whose codebooks are refined over Hilbert-sorted flat blocks.

Vectors become integers and are cut into ``PARTS`` parts. A task takes its rows in chunks; within a chunk the parts of
each position are sorted along a Hilbert curve and laid flat in blocks of ``BLOCK`` neighbours, each with the least and
greatest value of every component (its box) and the sum of its members. Blocks are stored once and read in every round:
the distances between a box and the codebook's entries leave a shortlist for the block, those entries that are nearest
to some point of the box. A shortlist of one takes the block whole, by its sum; longer ones are decided member by
member by a small integer kernel over the shortlist. All of it is exact in 64-bit integers.

Rows never leave their task: a round moves sums of a codebook's size. Memory is one chunk's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, durable, ready, salted_lookup, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 128
#: Integers of a chunk (16 MB as stored), and of the vectors in one stored row.
CHUNK_INTS, ROW_INTS = 1 << 22, 1 << 16
HEAD = -1
STORED = "part int, n int, data binary, low binary, high binary, total binary, members binary"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    size = F.lit(float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < size)), F.lit(False))


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Positions along a Hilbert curve through the box of the points (n, d); of many components, the 16 widest count."""
    low, span = points.min(0), points.max(0) - points.min(0)
    axes = np.sort(np.argsort(-span, kind="stable")[:16])
    bits = min(16, 62 // len(axes))
    x = [(((points[:, a] - low[a]) * ((1 << bits) - 1)) // max(1, int(span[a]))).astype(np.uint64) for a in axes]
    d, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the turns of the curve, highest bit first
        mask, bit = np.uint64((1 << b) - 1), np.uint64(b)
        for i in range(d):
            inside = (x[i] >> bit & one).astype(bool)
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & mask)
            x[0] = np.where(inside, x[0] ^ mask, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, d):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b) & one).astype(bool), np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << one | ((v ^ flip) >> np.uint64(b) & one)
    return key


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of every component."""
    out = np.floor(vectors.astype(np.float64) * SCALE)
    if len(out) and max(1, vectors.shape[1] // PARTS) * (2 * np.abs(out).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large for squared distances in 64-bit integers")
    return out.astype(np.int64)


def chunk_rows(ids: pa.Array, labels: pa.Array, vectors: np.ndarray) -> Iterator[tuple]:
    """The stored rows of one chunk: its ids and labels, then the blocks of every part."""
    sink = pa.BufferOutputStream()
    head = pa.RecordBatch.from_arrays([ids, labels], ["vec_id", "label"])
    with pa.ipc.new_stream(sink, head.schema) as writer:
        writer.write_batch(head)
    yield HEAD, len(ids), sink.getvalue().to_pybytes(), b"", b"", b"", b""
    width = vectors.shape[1] // PARTS
    step = max(1, ROW_INTS // (BLOCK * width)) * BLOCK
    for part in range(PARTS):
        own = vectors[:, part * width : (part + 1) * width]
        order = np.argsort(hilbert_keys(own), kind="stable")
        for at in range(0, len(order), step):
            members = order[at : at + step]
            flat = own[members]
            starts = np.arange(0, len(flat), BLOCK)
            boxes = [f.reduceat(flat, starts, 0).tobytes() for f in (np.minimum, np.maximum, np.add)]
            yield part, len(members), flat.astype(np.int32).tobytes(), *boxes, members.astype(np.int32).tobytes()


def stored_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in STORED.split(", ")])


def blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Rows (vec_id, label, embedding) of one length -> stored chunks, each whole and in order within its partition."""
    most = max(BLOCK, CHUNK_INTS // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            vectors = t.column("embedding").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim)
            for row in chunk_rows(t.column("vec_id").chunk(0), t.column("label").chunk(0), integers(vectors)):
                yield stored_batch([row])

        for batch in batches:
            while len(batch):
                room = most - sum(map(len, held))
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(map(len, held)) == most:
                    yield from flush()
        if held and sum(map(len, held)):
            yield from flush()

    return rows.mapInArrow(run, STORED)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(blocks, entries) true where an entry may be nearest to a point of the block's box, ties included."""
    below, above = low[:, None, :] - entries, entries - high[:, None, :]
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
    farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
    return nearest <= farthest.min(1)[:, None]


class Blocks:
    """One stored row of blocks."""

    def __init__(self, row: dict, width: int):
        self.part, self.n = row["part"], row["n"]
        self.flat = np.frombuffer(row["data"], np.int32).reshape(self.n, width).astype(np.int64)
        self.low, self.high, self.total = (np.frombuffer(row[c], np.int64).reshape(-1, width) for c in ("low", "high", "total"))
        self.sizes = np.minimum(BLOCK, self.n - np.arange(len(self.low)) * BLOCK)
        self.block = np.repeat(np.arange(len(self.low)), self.sizes)

    def nearest(self, entries: np.ndarray, chosen: np.ndarray, shortlist: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(members, entry, squared distance) of the members of the ``chosen`` blocks, a kernel for each shortlist length."""
        lengths = np.where(chosen, shortlist.sum(1), 0)
        listed = np.argsort(~shortlist, axis=1, kind="stable")  # a shortlist's entries first, lower index first
        for k in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths[self.block] == k)
            options = listed[self.block[at], :k]
            far = ((self.flat[at][:, None, :] - entries[options]) ** 2).sum(2)
            best = far.argmin(1)
            every = np.arange(len(at))
            yield at, options[every, best], far[every, best]


def round_sums(stored: DataFrame, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: sums (parts, entries, width) and counts (parts, entries) of what is assigned to each entry."""
    parts, entries, width = codebooks.shape
    shared = stored.sparkSession.sparkContext.broadcast(codebooks)  # ENTRIES vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.select(["part", "n", "data", "low", "high", "total"]).to_pylist():
                b, book = Blocks(row, width), shared.value[row["part"]]
                short = shortlists(b.low, b.high, book)
                whole = short.sum(1) == 1
                to = short[whole].argmax(1)
                np.add.at(sums[b.part], to, b.total[whole])
                np.add.at(counts[b.part], to, b.sizes[whole])
                for at, entry, _ in b.nearest(book, ~whole, short):
                    np.add.at(sums[b.part], entry, b.flat[at])
                    counts[b.part] += np.bincount(entry, minlength=entries)
        slots = np.arange(sums.size)
        used = np.repeat(counts.ravel(), width) > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (slots, sums.ravel(), np.repeat(counts.ravel(), width))], ["slot", "total", "n"])

    found = stored.where(F.col("part") != HEAD).mapInArrow(run, "slot long, total long, n long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    sums, counts = np.zeros(codebooks.size, np.int64), np.zeros(codebooks.size, np.int64)
    for r in found:  # at most a codebook's numbers
        sums[r.slot], counts[r.slot] = r.total, r.n
    return sums.reshape(codebooks.shape), counts.reshape(codebooks.shape)[:, :, 0]


def coded(stored: DataFrame, codebooks: np.ndarray, label_type: str) -> DataFrame:
    """(vec_id, label, code, error) of every row, chunk by chunk."""
    width = codebooks.shape[2]
    shared = stored.sparkSession.sparkContext.broadcast(codebooks)
    names = ["vec_id", "label", "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: pa.RecordBatch | None = None
        codes, errors = np.zeros((0, PARTS), np.uint8), np.zeros(0, np.int64)

        def done(head: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] == HEAD:
                    if head is not None:
                        yield done(head)
                    head = pa.ipc.open_stream(row["data"]).read_next_batch()
                    codes, errors = np.zeros((len(head), PARTS), np.uint8), np.zeros(len(head), np.int64)
                    continue
                b, book, members = Blocks(row, width), shared.value[row["part"]], np.frombuffer(row["members"], np.int32)
                short = shortlists(b.low, b.high, book)
                for at, entry, far in b.nearest(book, np.ones(len(short), bool), short):
                    codes[members[at], b.part] = entry
                    errors[members[at]] += far
        if head is not None:
            yield done(head)

    return stored.mapInArrow(run, f"vec_id long, label {label_type}, code string, error long")


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a whole vector.

    Rows whose vector is null, or has null or non-finite components, go. Vectors have one length, a multiple of PARTS: that of most
    rows, the longer one on ties; rows of other lengths can't be cut alike and go as well. The first codebooks are the
    parts of the ENTRIES rows with the smallest ids, equal ids by their vectors, rows without an id last; fewer rows make
    a smaller codebook. Rows that repeat an id or a vector are rows like others. label_error is the sum over all rows of
    equal labels, null labels together. Components must stay below some 2**16, else distances pass 64 bits and it fails.
    An empty table gives no rows.
    """
    spark = ready(vectors.sparkSession)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label, "embedding").where(finite(F.col("embedding")))
    label_type = rows.schema["label"].dataType.simpleString()
    size = rows.groupBy(F.size("embedding").alias("d")).count().where(f"d > 0 and d % {PARTS} = 0").orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = int(size["d"])
    rows = rows.where(F.size("embedding") == dim)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()
    books = integers(np.array([r.embedding for r in first], np.float64)).reshape(len(first), PARTS, dim // PARTS).transpose(1, 0, 2).copy()
    stored = durable(blocks(rows, dim))
    for _ in range(rounds):
        sums, counts = round_sums(stored, books)
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = durable(coded(stored, books, label_type)).withColumn("label_key", F.to_json(F.struct("label")))
    errors = durable(out.groupBy("label_key").agg(F.sum("error").alias("label_error")))
    n = errors.count()
    out = out.join(small(errors, n), "label_key", "left") if n <= SMALL_ROWS else salted_lookup(out, errors, ["label_key"], "code", 64)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
