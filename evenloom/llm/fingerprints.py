"""Canonical exact digests of documents.

The canonical form of a text is its NFKC normalisation, case-folded and normalised again, with every run of white
space as one space and none at the ends. The fingerprint is the 128-bit XXH3 of its UTF-8 bytes. Rows are grouped by
digest, and inside a bucket of several rows the canonical bytes themselves are compared (they travel compressed, which
keeps equality): should different texts share a digest, the later ones get a numbered suffix, so that equal
fingerprints always mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions, ready, whole

SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in SCHEMA.split(", ")])
NO_ID = -(1 << 63)
MARKS = 1 << 23


def canonical(text: str) -> bytes:
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def packed(data: bytes) -> bytes:
    """Compressed for the way: the size, then the bytes."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("id"), whole(text_column).alias("text"))


def digests(texts: DataFrame) -> DataFrame:
    """texts(id, text) -> (id, fingerprint), the digest before any comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(t)) for t in batch.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])

    return texts.mapInArrow(run, "id long, fingerprint string")


def marks(several: DataFrame) -> bytes:
    """A bitmap of MARKS bits with a bit set for each of the fingerprints; the same size for any number of them."""
    at = F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long") % MARKS
    words = several.select(F.floor(at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = np.zeros(MARKS // 64, np.int64)
    for r in words.collect():  # at most MARKS / 64 rows
        found[r.w] = r.b
    return found.tobytes()


def bodies(texts: DataFrame, several: DataFrame) -> DataFrame:
    """(id, fingerprint, body) of the rows whose digest is among several(fingerprint), and of some that share a mark by
    chance; body is the compressed canonical form. Rows without a mark stay where they are."""
    shared = texts.sparkSession.sparkContext.broadcast(marks(several))  # MARKS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = canonical(text)
                found = digest(form)
                at = int(found[:8], 16) % MARKS
                if marked[at >> 3] >> (at & 7) & 1:
                    out.append((key, found, packed(form)))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary()))], ["id", "fingerprint", "body"])

    return texts.mapInArrow(run, "id long, fingerprint string, body binary")


def suffixes(texts: DataFrame) -> DataFrame:
    """texts(id, text) -> (id, fingerprint, suffix) of the rows whose digest an earlier, different text has as well.

    The digests of all rows are counted first; only rows in buckets of several go on with their bytes, and equal
    bytes of a partition travel on once, so a text that a third of all rows share costs no more than another.
    """
    several = durable(digests(texts).groupBy("fingerprint").count().where("count > 1").select("fingerprint"))
    rows = bodies(texts, several)
    different = rows.groupBy("fingerprint", "body").count()
    clash = durable(different.groupBy("fingerprint").agg(F.count("*").alias("texts")).where("texts > 1").select("fingerprint"))
    if clash.isEmpty():
        return texts.sparkSession.createDataFrame([], "id long, fingerprint string, suffix string")
    order = F.array_sort(F.collect_list("body"))  # different texts with one 128-bit digest
    place = different.join(clash, "fingerprint").groupBy("fingerprint").agg(order.alias("all")).select("fingerprint", F.posexplode("all").alias("place", "body"))
    return rows.join(place.where("place > 0"), ["fingerprint", "body"]).select("id", "fingerprint", F.concat(F.lit("-"), F.col("place").cast("string")).alias("suffix"))


def verified(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows with (id, fingerprint) get the suffix of their text's place among different texts of one digest."""
    extra = suffixes(texts)
    if extra.isEmpty():
        return rows
    found = rows.join(extra.distinct(), ["id", "fingerprint"], "left")
    return found.withColumn("fingerprint", F.concat("fingerprint", F.coalesce("suffix", F.lit("")))).select(rows.columns)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; null texts count as empty, an empty table gives none."""
    texts = _texts(docs, id_column, text_column)
    return verified(digests(texts), texts).withColumnRenamed("id", id_column)


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(key: int, own: str, own_form: bytes, text: str, form: bytes) -> tuple:
    changed = edited(own, text)
    changed_form = canonical(changed)
    return (key, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(own_form), digest(changed_form), float(changed_form == own_form), float(form == own_form))


def edit_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every text's fingerprint against that of its edited text and of the next document's.

    Next is by ascending id (by the hash of the text where rows share an id), after the last the first; a single row
    is its own next. Likeness is 1 for equal canonical bytes, else 0. Null texts count as empty and null ids come
    first. Rows are dealt by id ranges, and the first row of each range also goes to the range before it, so no order
    is taken over the whole table in one place. The ranges come from a quantile sketch and only even out the work.
    """
    spark = ready(docs.sparkSession)
    n = partitions(spark)
    texts = _texts(docs, id_column, text_column)
    plain = texts.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    cuts = sorted(set(plain.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    place = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<bigint>"), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    part = place.cast("int")
    firsts = sorted((r.part, r.id) for r in plain.groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect())  # a row a range
    before = [(firsts[k][1], firsts[k - 1][0]) for k in range(len(firsts))]
    guest_of = spark.createDataFrame(before, "id long, guest_in int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [packed(t.encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(bodies, pa.binary())], ["part", "id", "tie", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by (part, guest, id, tie): a range's rows, then the one that follows, or those of one id that follow
        held: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for part, guest, key, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if guest and (held is None or held[0] != part):
                    continue  # only the first of the guests counts
                text = unpacked(body).decode("utf-8", "surrogatepass")
                form = canonical(text)
                if held is not None and held[0] == part:
                    out.append(compared(*held[1:], text, form))
                held = None if guest else (part, key, text, form)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)] if out else [pa.array([], f.type) for f in ARROW], schema=ARROW)

    rows = plain.select(part.alias("part"), "id", F.xxhash64("text").alias("tie"), "text").mapInArrow(pack, "part int, id long, tie long, body binary")
    rows = rows.join(F.broadcast(guest_of), "id", "left")  # a row for each range, as many as there are partitions
    both = F.explode(F.when(F.col("guest_in").isNull(), F.array(F.struct(F.col("part"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("guest")), F.struct(F.col("guest_in").alias("part"), F.lit(True).alias("guest")))))
    dealt = rows.select("id", "tie", "body", both.alias("to")).select("to.part", "to.guest", "id", "tie", "body")
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", "guest", "id", "tie")
    out = dealt.select("part", "guest", "id", "body").mapInArrow(run, SCHEMA)
    out = verified(out, plain)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_column)
