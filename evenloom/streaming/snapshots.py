"""Stateful operators over a stream of nightly snapshots.

Each reads a stream of rows that carry ``night`` (a timestamp) and keeps keyed state: what a source had when it was
last healthy, when an event was first seen, which messages went out. They are the streaming form of operators.state
and give the same rows for the same nights.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP_DAYS = 7
VERDICTS = "source string, night timestamp, n long, verdict string, ok timestamp"


def counts_per_night(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """events(source, night) -> (source, night, n), final once the watermark has passed the night."""
    return events.withWatermark("night", delay).groupBy("source", F.window("night", "1 day")).agg(F.count("*").alias("n")).select("source", F.col("window.start").alias("night"), "n")


def safety_net(counts: DataFrame, min_items: int = 6, days: int = KEEP_DAYS) -> DataFrame:
    """counts(source, night, n), a row per source and night -> VERDICTS.

    State of a source: the last night it was healthy and what counts as its previous number. While it is silent its
    carried items keep counting; after release the next night is healthy again.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ok, before = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("night")
        out = []
        for night, n in zip(rows["night"], rows["n"]):
            silent = before >= min_items and (n == 0 or (before >= 20 and n < before * 0.25))
            stamp = int(night.value // 1000)
            if not silent:
                verdict, ok, before = "ok", stamp, int(n)
            else:
                ok = stamp if ok is None else ok
                held = (stamp - ok) // 86_400_000_000 < days
                verdict = "houd" if held else "vervallen"
                before = before if held else int(n)
            out.append((key[0], night, int(n), verdict, pd.Timestamp(ok * 1000)))
        state.update((ok, before))
        yield pd.DataFrame(out, columns=["source", "night", "n", "verdict", "ok"])

    return counts.groupBy("source").applyInPandasWithState(step, VERDICTS, "ok long, before long", "append", GroupStateTimeout.NoTimeout)


def first_seen(events: DataFrame) -> DataFrame:
    """events(id, night) -> (id, first_seen): the earliest night of each id; for update or complete output."""
    return events.groupBy("id").agg(F.min("night").alias("first_seen"))


def not_yet_sent(hits: DataFrame, days: int = 60) -> DataFrame:
    """hits(id, night): the first hit of an id within ``days`` days; older state expires by watermark."""
    return hits.withWatermark("night", f"{days} days").dropDuplicatesWithinWatermark(["id"])


def handover_carry(counts: DataFrame, days: int = 14, least: int = 6) -> DataFrame:
    """counts(source, night, n), a row per source and night -> VERDICTS of hand-overs.

    A source that gives none where it had ``least`` items or more keeps those for up to ``days`` days after they were
    fetched ("houd"), the last day included; then they go ("vervallen"). ok is the night of the items that count.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fetched, held = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("night")
        out = []
        for night, n in zip(rows["night"], rows["n"]):
            stamp = int(night.value // 1000)
            if n or held < least:
                verdict, fetched, held = "ok", stamp, int(n)
            elif (stamp - fetched) // 86_400_000_000 <= days:
                verdict = "houd"
            else:
                verdict, fetched, held = "vervallen", stamp, 0
            out.append((key[0], night, int(n), verdict, pd.Timestamp(fetched * 1000)))
        state.update((fetched, held))
        yield pd.DataFrame(out, columns=["source", "night", "n", "verdict", "ok"])

    return counts.groupBy("source").applyInPandasWithState(step, VERDICTS, "fetched long, held long", "append", GroupStateTimeout.NoTimeout)
