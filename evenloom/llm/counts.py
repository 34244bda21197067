"""Token counts of a unigram tokenizer by dynamic programming shared in a trie.

The unigram segmentation of a pre-token is the best sum of piece scores over its bytes (forward maximum; the fewest
pieces on ties). Forward scores depend on the prefix only, so distinct pre-tokens are inserted in a trie whose nodes
keep the score and piece count of their prefix: each shared prefix is computed once, and the node where a pre-token
ends has its count. A node looks back at most the longest piece. A task keeps one trie for all its documents and
starts anew beyond ``MAX_NODES`` nodes, so its memory is bounded and no pre-token is ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import public_vocabulary, read_ranks
from .common import ready, strings, whole

MAX_NODES = 1_500_000


def rank_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Unigram log-probabilities that follow Zipf's law over the ranks of a given vocabulary; nothing is trained."""
    total = math.log(sum(1 / (r + 2) for r in ranks.values()))
    return {t: -math.log(r + 2) - total for t, r in ranks.items()}


class ForwardTrie:
    def __init__(self, scores: dict[bytes, float], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.terminal: dict[str, int] = {"": 0}

    def insert(self, piece: str) -> int:
        """The number of pieces of a pre-token."""
        if len(self.best) > self.max_nodes:
            self.clear()
        data = piece.encode("utf-8", "surrogatepass")
        path, child, best, count, score = [0], self.child, self.best, self.count, self.scores.get
        for end in range(1, len(data) + 1):
            at = path[-1] * 256 + data[end - 1]
            node = child.get(at)
            if node is None:
                top, fewest = -math.inf, 0
                for start in range(max(0, end - self.longest), end):
                    own = score(data[start:end])
                    if own is not None:
                        value, n = best[path[start]] + own, count[path[start]] + 1
                        if value > top or value == top and n < fewest:
                            top, fewest = value, n
                if top == -math.inf:
                    raise ValueError(f"no piece ends at byte {end} of {piece[:40]!r}")
                node = child[at] = len(best)
                best.append(top)
                count.append(fewest)
            path.append(node)
        found = count[path[-1]]
        if len(piece) <= 64:
            self.terminal[piece] = found
        return found


def token_counts(docs: DataFrame, vocabulary: bytes | None = None, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) of every whole text; null and empty texts have none."""
    spark = ready(docs.sparkSession)
    if vocabulary is None or pattern is None:
        vocabulary, pattern = public_vocabulary()
    shared = spark.sparkContext.broadcast(vocabulary)  # a fixed file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, split = ForwardTrie(rank_scores(read_ranks(shared.value))), regex.compile(pattern).findall
        for batch in batches:
            totals, pieces = [], []
            for text in strings(batch.column(1)):
                found = split(text)
                known = trie.terminal
                for p in sorted({p for p in found if p not in known}):  # neighbours share the longest prefixes
                    trie.insert(p)
                known = trie.terminal
                totals.append(sum(known[p] if p in known else trie.insert(p) for p in found))
                pieces.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(pieces, pa.int64())], ["id", "n_tokens", "n_pretokens"])

    plain = docs.select(F.col(id_column).cast("long").alias("id"), whole(text_column).alias("text"))
    return plain.mapInArrow(run, "id long, n_tokens long, n_pretokens long").withColumnRenamed("id", id_column)
