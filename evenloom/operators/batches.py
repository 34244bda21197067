"""Arrow batches of texts of any length: a worker holds a few megabytes of them, however many rows a batch has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a batch that Spark sends to a worker, and of the texts that are Python objects at once.
BATCH_BYTES, SLICE_BYTES = 16 << 20, 1 << 20


def slim_batches(df: DataFrame) -> DataFrame:
    """The same rows; batches of the session end at BATCH_BYTES, unless a lower bound is set."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def few_at_once(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes, by their mean row; one row at least."""
    for batch in batches:
        each = max(1, int(len(batch) * most / max(1, batch.nbytes)))
        for at in range(0, len(batch), each):
            yield batch.slice(at, each)


def packed_rows(rows: list[tuple], names: list[str], kinds: pa.Schema, each: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``each`` at most."""
    for at in range(0, len(rows), each):
        some = list(zip(*rows[at : at + each]))
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(n).type) for c, n in zip(some, names)], names)
