"""Nightly rules over a stream, by keyed state with event-time timers.

Rows are (source, night, n). They wait in state until the watermark has passed their night, so that late nights fall in
their place and a night that comes twice counts once, with its larger number. A night without a row is a night with
nothing for as long as a source has something to lose: a timer lets a silent source go without any row of it, and then
its state goes as well. Sources that hold nothing keep no state and no timer.

The rules are those of ``operators.state`` and ``streaming.snapshots`` and give the same verdicts for the same nights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
#: (since, held): the night that counts as the last good one, in milliseconds, and how many items are held from it.
State = tuple[int, int]
#: (state or None, night, n) -> (verdict, state).
Rule = Callable[[State | None, int, int], tuple[str, State]]
VERDICTS = "source string, at long, n long, verdict string, since long"


def safety_rule(min_items: int = 6, days: int = 7) -> Rule:
    """A source that falls silent keeps its items for less than ``days`` days after its last healthy night."""

    def step(state: State | None, night: int, n: int) -> tuple[str, State]:
        since, held = state or (night, 0)
        if not (held >= min_items and (n == 0 or (held >= 20 and n < held * 0.25))):
            return "ok", (night, n)
        return ("houd", (since, held)) if (night - since) // DAY < days else ("vervallen", (since, n))

    return step


def handover_rule(least: int = 6, days: int = 14) -> Rule:
    """A hand-over that gives none keeps the items of the last one up to ``days`` days after it, the last day included."""

    def step(state: State | None, night: int, n: int) -> tuple[str, State]:
        since, held = state or (night, 0)
        if n or held < least:
            return "ok", (night, n)
        return ("houd", (since, held)) if (night - since) // DAY <= days else ("vervallen", (night, 0))

    return step


class Nightly(StatefulProcessor):
    """Applies a rule night by night up to the watermark."""

    def __init__(self, rule: Rule, least: int):
        self.rule, self.least = rule, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "since long, held long, last long")
        self.waiting = handle.getMapState("waiting", "night long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[2] if self.state.exists() else None
        for frame in rows:
            for night, n in zip(frame["at"].tolist(), frame["n"].tolist()):
                night -= night % DAY
                if last is not None and night <= last:
                    continue  # decided already
                before = self.waiting.getValue((night,))[0] if self.waiting.containsKey((night,)) else -1
                self.waiting.updateValue((night,), (max(int(n), before),))
        yield self.advance(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advance(key[0], timerValues.getCurrentWatermarkInMs())

    def advance(self, source: str, watermark: int) -> pd.DataFrame:
        """Decide the nights that the watermark has passed, given ones and those missing while something is held."""
        since, held, last = self.state.get() if self.state.exists() else (None, 0, None)
        waiting = sorted(k[0] for k in self.waiting.keys()) if self.waiting.exists() else []
        out = []
        while True:
            due = waiting[0] if waiting else None
            if last is not None and held >= self.least and (due is None or due > last + DAY):
                due = last + DAY  # a night without a row
            if due is None or due > watermark:
                break
            n = 0
            if waiting and waiting[0] == due:
                n = self.waiting.getValue((waiting.pop(0),))[0]
                self.waiting.removeKey((due,))
            verdict, (since, held) = self.rule(None if since is None else (since, held), due, int(n))
            last = due
            out.append((source, due, int(n), verdict, since))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)
        if last is not None and held < self.least and not waiting:
            self.state.clear()  # nothing held and nothing to come: the next row is a first one
            self.waiting.clear()
        elif last is not None:
            self.state.update((since, held, last))
        return pd.DataFrame(out, columns=["source", "at", "n", "verdict", "since"])

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> SparkSession:
    """Timers and several states of a key need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def verdicts(counts: DataFrame, rule: Rule, least: int = 6, delay: str = "2 days") -> DataFrame:
    """A stream counts(source, night, n) -> (source, night, n, verdict, since); ``delay`` is how late a night may come.

    A source whose state has gone begins anew. Rows later than the delay are dropped.
    """
    stateful(counts.sparkSession)
    rows = counts.withWatermark("night", delay).select("source", "night", F.unix_millis("night").alias("at"), F.col("n").cast("long").alias("n"))
    out = rows.groupBy("source").transformWithStateInPandas(Nightly(rule, least), VERDICTS, "Append", "eventTime")
    return out.select("source", F.timestamp_millis("at").alias("night"), "n", "verdict", F.timestamp_millis("since").alias("since"))
