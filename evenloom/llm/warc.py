"""WARC archives: writing, a normaliser of monolithic gzip files, and reading by offset.

Archives of any origin may be one gzip stream around all records, which can only be read from the start. The
normaliser inflates such a file once, in chunks, rewrites every record as a gzip member of its own, and writes an index
beside it (one JSON line a record: id, type, offset, length), so that readers can fetch any record by its offset. All
steps hold one chunk at a time. Files go to a folder that driver and executors share, through pyarrow's file systems;
a task writes to a name of its own and renames at the end, so a lost or repeated task leaves no half file.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ready, salted_lookup, shared_dir, whole

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)


def record_id(page_id: int) -> str:
    return f"<urn:x-page:{page_id}>"


def page_of(urn: str) -> int:
    return int(urn.strip("<>").rpartition(":")[2])


def clean(url: str | None) -> str:
    """A header value: no line breaks."""
    return "".join(c for c in url or "" if c >= " " and c != "\x7f") or "urn:x-none"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit record: the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a chunk at a time."""
    z = zlib.decompressobj(31)
    begun = False
    while data := source.read(CHUNK):
        while data:
            out = z.decompress(data, CHUNK)
            begun = True
            if out:
                yield out
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if begun:
        raise EOFError("the gzip stream ends within a member")


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


class Reader:
    """Records of a stream of chunks: headers, then the block in chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def more(self) -> bool:
        got = next(self.chunks, None)
        if got is None:
            return False
        self.held += got
        return True

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise EOFError("a record is shorter than its Content-Length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def __iter__(self) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
        while True:
            while (at := self.held.find(b"\r\n\r\n")) < 0:
                if not self.more():
                    if self.held.strip():
                        raise EOFError("the archive ends within a header")
                    return
            head, self.held = self.held[: at + 4], self.held[at + 4 :]
            headers = parse_headers(head[:-4])
            if not headers[""].startswith("WARC/"):
                raise ValueError(f"no WARC record begins with {headers['']!r}")
            block = self.take(int(headers["content-length"]))
            yield head, headers, block
            for _ in block:  # what the caller left
                pass
            if b"".join(self.take(4)) != b"\r\n\r\n":
                raise ValueError("a record isn't followed by two line ends")


def normalise(source: BinaryIO, target: BinaryIO, level: int = 6) -> Iterator[dict]:
    """Rewrite a gzip archive record by record; yields the index entries in order."""
    offset = 0
    for head, headers, block in Reader(inflate(source)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        length = target.write(z.compress(head))
        for chunk in block:
            length += target.write(z.compress(chunk))
        length += target.write(z.compress(b"\r\n\r\n") + z.flush())
        yield {"record_id": headers["warc-record-id"], "type": headers["warc-type"], "offset": offset, "length": length}
        offset += length


class Part:
    """``length`` bytes of a file from ``offset`` on."""

    def __init__(self, source: BinaryIO, offset: int, length: int):
        source.seek(offset)
        self.source, self.left = source, length

    def read(self, n: int) -> bytes:
        data = self.source.read(min(n, self.left))
        self.left -= len(data)
        return data


def payload_report(member: BinaryIO) -> tuple[int, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record's member, a chunk at a time."""
    for _, headers, block in Reader(inflate(member)):
        http, digest, size = b"", None, 0
        for chunk in block:
            if digest is None:
                http += chunk
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, chunk, digest = http[:at], http[at + 4 :], hashlib.sha1()
            digest.update(chunk)
            size += len(chunk)
        stated, stated_size = headers["warc-payload-digest"].removeprefix("sha1:"), int(parse_headers(http)["content-length"])
        if headers["warc-type"] == "revisit":
            return page_of(headers["warc-record-id"]), stated_size, stated, "revisit", page_of(headers["warc-refers-to"])
        found = base64.b32encode(digest.digest()).decode() if digest else ""
        if found != stated or size != stated_size:
            raise ValueError(f"{headers['warc-record-id']}: the payload isn't what its header says")
        return page_of(headers["warc-record-id"]), size, found, "response", None
    raise ValueError("an empty member")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def publish(root: str, name: str, write: Callable[[BinaryIO], None]) -> str:
    """Write a file under a name of its own, then rename it."""
    where, path = fs.FileSystem.from_uri(root)
    where.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own, compression=None) as out:
        write(out)
    where.move(own, f"{path}/{name}")
    return f"{root}/{name}"


def kinds(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, refers_to) of every row: the hex SHA-1 of its payload and what it refers to; payloads stay behind.

    Payloads are equal if SHA-1, length and an independent hash agree. Of equal ones the largest page_id is the
    response, also if it has several rows. A null page_id refers to the others' largest.
    """
    html = whole("html")
    keyed = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), "url", F.sha1(html).alias("digest"), F.octet_length(html).alias("n"), F.xxhash64(html).alias("other"))
    key = ["digest", "n", "other"]
    largest = keyed.groupBy(*key).agg(F.max("page_id").alias("last"), F.count("*").alias("rows"))
    found = salted_lookup(keyed, largest.where("rows > 1").drop("rows"), key, F.struct("page_id", "url"))  # a payload of one row refers to none
    return found.select("page_id", "url", "digest", F.when(F.col("page_id") != F.col("last"), F.col("last")).alias("refers_to"))


ROW = "page_id long, digest string, payload binary, url string, refers_to long"
#: Bytes of a record besides its payload, for dealing.
HEADERS = 700


def payloads(pages: DataFrame) -> DataFrame:
    """ROW of every page with its compressed payload, to be met by the rows of kinds()."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(3).to_pylist()]
            packed = [len(t).to_bytes(8, "little") + pa.compress(t, "zstd", asbytes=True) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), batch.column(2), pa.nulls(len(raw), pa.int64())], [x.split()[0] for x in ROW.split(", ")])

    html = whole("html")
    body = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.sha1(html).alias("digest"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return body.mapInArrow(pack, ROW)


def write_archives(pages: DataFrame, root: str, archive_bytes: int = 32 << 20, level: int = 6) -> DataFrame:
    """Write pages as monolithic gzip archives of about ``archive_bytes`` of records; (path, n_records) of each.

    Each task writes the archive of its number. Rows are dealt by id, payload and url, so rows without an id spread too.
    """
    spark = ready(pages.sparkSession)
    size = pages.agg(F.sum(F.octet_length(whole("html")) + HEADERS)).first()[0] or 0
    n = max(1, -(-size // archive_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by (page_id, digest, url), of which the rows without payload come first
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5))))
        first = next(rows, None)
        if first is None:
            return
        archive, count = TaskContext.get().partitionId(), 0

        def write(out: BinaryIO) -> None:
            nonlocal count
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            out.write(z.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{archive}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()))
            waiting: list[tuple] = []
            for row in itertools.chain([first], rows):
                if row[2] is None:
                    waiting.append(row)
                elif waiting:  # a repeated row's payload finds its records written
                    payload = pa.decompress(row[2][8:], int.from_bytes(row[2][:8], "little"), "zstd", asbytes=True)
                    digest = base64.b32encode(bytes.fromhex(row[1])).decode()
                    for page_id, _, _, url, refers_to in waiting:
                        out.write(z.compress(record(page_id, url, payload, digest, refers_to)))
                        count += 1
                    waiting.clear()
            out.write(z.flush())

        path = publish(f"{root}/raw", f"pages-{archive:06d}.warc.gz", write)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count]})

    told = kinds(pages).select("page_id", "digest", F.lit(None).cast("binary").alias("payload"), F.col("url").cast("string").alias("url"), "refers_to")
    both = told.unionByName(payloads(pages)).withColumn("whole", F.col("payload").isNotNull())
    dealt = both.repartition(min(n, 1 << 20), "page_id", "digest", "url").sortWithinPartitions("page_id", "digest", "url", "whole")
    return durable(dealt.select("page_id", "digest", "payload", "url", "refers_to").mapInArrow(run, "path string, n_records long"))


def normalise_archives(archives: DataFrame, root: str, level: int = 6) -> DataFrame:
    """archives(path) -> (path, record_id, type, offset, length): the index of the normalised archives, also written beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rpartition("/")[2]
                where, plain = fs.FileSystem.from_uri(path)
                entries: list[dict] = []

                def write(out: BinaryIO, where=where, plain=plain, entries=entries) -> None:
                    with where.open_input_stream(plain, compression=None) as source:
                        entries.extend(normalise(source, out, level))

                target = publish(f"{root}/records", name, write)
                publish(f"{root}/records", name.removesuffix(".warc.gz") + ".idx.jsonl", lambda out, entries=entries: [out.write(json.dumps(e).encode() + b"\n") for e in entries])
                cols = {k: [e[k] for e in entries] for k in ("record_id", "type", "offset", "length")}
                yield pa.RecordBatch.from_pydict({"path": [target] * len(entries)} | cols)

    ready(archives.sparkSession)
    # archives come one a partition from write_archives()
    return durable(archives.select("path").mapInArrow(run, "path string, record_id string, type string, offset long, length long"))


def read_records(index: DataFrame) -> DataFrame:
    """index(path, type, offset, length) -> (page_id, payload_bytes, payload_digest, record_type, refers_to) of each page's record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, source = None, None
        for batch in batches:
            out = []
            for path, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if path != open_path:
                    if source is not None:
                        source.close()
                    where, plain = fs.FileSystem.from_uri(path)
                    open_path, source = path, where.open_input_file(plain)
                out.append(payload_report(Part(source, offset, length)))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if source is not None:
            source.close()

    ready(index.sparkSession)
    found = index.where("type <> 'warcinfo'").select("path", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.select(known("page_id"), "payload_bytes", "payload_digest", "record_type", known("refers_to"))


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write the pages, normalise the archives and read every record back; null html counts as empty, an empty table gives none."""
    ready(pages.sparkSession)
    root = root or f"{shared_dir(pages.sparkSession).rstrip("/")}/warc-{uuid.uuid4().hex}"
    return read_records(normalise_archives(write_archives(pages, root), root))
