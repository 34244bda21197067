"""Byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is the BPE encoding of its bytes exactly if every neighbouring pair of tokens encodes to itself:
the first merge across a boundary would already happen in the pair alone. So the encodings are the paths of a
nondeterministic transducer with states (last finished token, position in the vocabulary's trie), where a token may
follow only a compatible one. It is determinised while reading: a deterministic state is the set of live hypotheses.
Exactly one of them has just finished a token, the last one of the encoding of all that was read, so a transition
outputs that token; tokens are emitted once the paths of all live hypotheses share them. Hypotheses begin at different
bytes and none is longer than the longest token, so lookahead and state size are bounded. States and transitions are
made when first needed and kept up to a limit, beyond which the cache starts anew.

Pieces are the matches of the split pattern; a piece that is itself a token is that token, as in tiktoken.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, strings, whole

MEMO, SLICE = 150_000, 1 << 16
STATES = 200_000
#: What a worker keeps of these from one task to the next.
KEPT = 50_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A vocabulary in tiktoken's format: a base64 token and its rank on every line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Encoder of single pieces; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.token_at: dict[int, int] = {}
        nodes, self.depth = 1, [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                at = node * 256 + b
                if at not in self.child:
                    self.child[at] = nodes
                    nodes += 1
                    self.depth.append(self.depth[node] + 1)
                node = self.child[at]
            self.token_at[node] = rank
        self.size = {r: len(t) for t, r in ranks.items()}
        self.inner = {at >> 8 for at in self.child}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.index: dict[tuple, int] = {}  # a state's live hypotheses (last token or -1, trie node) -> its number
        self.members: list[tuple] = []
        self.step: dict[int, tuple[int, int]] = {}  # state * 256 + byte -> (state, the token that ends here)
        self.start = self.state(((-1, 0),))

    def state(self, members: tuple) -> int:
        if members not in self.index:
            self.index[members] = len(self.members)
            self.members.append(members)
        return self.index[members]

    def merged(self, piece: bytes) -> list[bytes]:
        """The definition: merge the neighbouring pair of lowest rank, leftmost first, while there is one."""
        parts, never, rank_of = [piece[i : i + 1] for i in range(len(piece))], len(self.ranks), self.ranks.get
        ranks = [rank_of(piece[i : i + 2], never) for i in range(len(piece) - 1)]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], never)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], never)
        return parts

    def compatible(self, last: int, token: int) -> bool:
        key = (last, token)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= 4 * self.max_states:
                self.fits.clear()
            b = self.bytes_of[token]
            found = self.fits[key] = self.merged(b) == [b] if last < 0 else self.merged(self.bytes_of[last] + b) == [self.bytes_of[last], b]
        return found

    def advance(self, state: int, byte: int) -> tuple[int, int]:
        """Follow one byte: the next state, and the last token of the encoding of all that was read."""
        live, done = [], -1
        for last, node in self.members[state]:
            to = self.child.get(node * 256 + byte)
            if to is None:
                continue
            if to in self.inner:
                live.append((last, to))
            token = self.token_at.get(to)
            if token is not None and done < 0 and self.compatible(last, token):
                done = token
        if done < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        live.append((done, 0))
        live.sort()
        out = self.step[state * 256 + byte] = (self.state(tuple(live)), done)
        return out

    def settled(self, state: int, ends: list[int], length: int) -> int:
        """How many of the read bytes no continuation can tokenise otherwise: where the paths of all hypotheses meet."""
        starts = {length - self.depth[node] for _, node in self.members[state]}
        while len(starts) > 1:
            far = max(starts)
            starts.discard(far)
            starts.add(far - self.size[ends[far - 1]])
        return starts.pop()

    def stream(self, data: Iterable[int], window: int = 4096) -> Iterator[list[int]]:
        """Tokens of one piece as they become certain; holds ``window`` bytes and the longest lookahead at most."""
        if len(self.members) > self.max_states:
            self.reset()
        state, step, ends = self.start, self.step, []
        for b in data:
            found = step.get(state * 256 + b)
            state, token = found if found is not None else self.advance(state, b)
            ends.append(token)
            if len(ends) >= window:
                at = self.settled(state, ends, len(ends))
                yield self.path(ends, at)
                del ends[:at]
        yield self.path(ends, len(ends))

    def path(self, ends: list[int], at: int) -> list[int]:
        out, size = [], self.size
        while at > 0:
            out.append(ends[at - 1])
            at -= size[ends[at - 1]]
        return out[::-1]

    def encode(self, piece: bytes, window: int = 4096) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) > window:
            return [t for tokens in self.stream(piece, window) for t in tokens]
        if len(self.members) > self.max_states:
            self.reset()
        state, step, ends = self.start, self.step.get, []
        for b in piece:
            found = step(state * 256 + b)
            state, token = found if found is not None else self.advance(state, b)
            ends.append(token)
        return self.path(ends, len(ends))

    def trim(self) -> None:
        if len(self.members) > KEPT:
            self.reset()
        if len(self.fits) > KEPT:
            self.fits.clear()


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.transducer = Transducer(read_ranks(vocabulary))
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}  # piece -> its ids, little-endian
        self.older: dict[str, bytes] = {}  # those of the time before; what is used again goes on
        self.token = self.transducer.bytes_of

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found = self.split(text)
        return b"".join([self._ids(found[at : at + SLICE]) for at in range(0, len(found), SLICE)])

    def _ids(self, found: list[str]) -> bytes:
        if len(self.pieces) > MEMO:
            self.older, self.pieces = self.pieces, {}
        known, older = self.pieces, self.older.get
        for p in set(found).difference(known):
            ids = older(p)
            if ids is None:
                ids = np.array(self.transducer.encode(p.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            known[p] = ids
        out = b"".join([known[p] for p in found])
        for p in [p for p in set(found) if len(p) > 64]:  # long pieces seldom return
            del known[p]
        return out

    def trim(self) -> None:
        """Let go of most of what a task has gathered: a worker lives on, and others share its machine."""
        self.pieces, self.older = {}, {}
        self.transducer.trim()

    def decode(self, ids: bytes, chunk: int = 65536) -> Iterator[bytes]:
        """The bytes of the ids, a chunk of tokens at a time."""
        numbers = np.frombuffer(ids, "<u4")
        for k in range(0, len(numbers), chunk):
            yield b"".join(map(self.token.__getitem__, numbers[k : k + chunk].tolist()))


class Utf8Stream:
    """Incremental UTF-8 decoding of byte chunks cut anywhere.

    The state is the unfinished sequence at the end of what came so far (at most three bytes). Bytes that begin or
    continue no sequence become U+FFFD, as does a sequence left open at the end.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def need(lead: int) -> int:
        """How many bytes a sequence with this first byte has; 0 if none begins so."""
        return 1 if lead < 0x80 else 0 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF5 else 0

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:  # a sequence begins here, or a single byte stands
                if self.need(b) > back and self.possible(data[-back:]):
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def possible(head: bytes) -> bool:
        """Whether the second byte, if it is there, may follow the first."""
        if len(head) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(head[0], (0x80, 0xBF))
        return low <= head[1] <= high

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def decode_text(chunks: Iterable[bytes]) -> Iterator[str]:
    stream = Utf8Stream()
    for chunk in chunks:
        yield stream.feed(chunk)
    yield stream.finish()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    key = (hashlib.sha256(vocabulary).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """A vocabulary file's bytes (under 1 MB, the same for any input) and the split pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoded(docs: DataFrame, vocabulary: bytes, pattern: str, ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_chars[, token_ids]) of every whole text.

    decoded_sha256 is of the bytes that decoding the ids gives, decoded_chars the code points that the streaming
    UTF-8 decoder makes of them. Null counts as empty: no tokens. Rows are independent, so repeated ids are repeated
    rows and an empty table gives none.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary)  # a fixed file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            out: list[tuple] = []
            for text in strings(batch.column(1)):
                got = c.encode(text)
                sha, stream, chars = hashlib.sha256(), Utf8Stream(), 0
                for chunk in c.decode(got):
                    sha.update(chunk)
                    chars += len(stream.feed(chunk))
                chars += len(stream.finish())
                out.append((len(got) // 4, hashlib.sha256(got).hexdigest(), sha.hexdigest(), chars, np.frombuffer(got, "<u4").astype(np.int32) if ids else None))
            cols = list(zip(*out)) if out else [()] * 5
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"]
            if ids:
                arrays.append(pa.array(list(cols[4]), pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        c.trim()

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long" + ", token_ids array<int>" * ids
    plain = docs.select(F.col(id_column).cast("long").alias("id"), whole(text_column).alias("text"))
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_column)
