"""State between snapshots: safety net, carried events, sent log, caches, publication gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_DAYS, MIN_ITEMS = 7, 6


def broken(previous, now, min_items: int = MIN_ITEMS):
    """A source is silent: enough items before, and now none, or under a quarter of 20 or more."""
    return (previous >= min_items) & ((now == 0) | ((previous >= 20) & (now < previous * 0.25)))


def source_safety_net(status: DataFrame, previous: DataFrame, current: DataFrame, today: str, days: int = KEEP_DAYS) -> DataFrame:
    """(source, verdict, ok, n): status(source, ok, n), previous(source, n), current(source, n).

    verdict is ok (healthy, status renewed), houd (keep the previous items) or vervallen (silent too long).
    """
    t = F.lit(today).cast("date")
    out = current.withColumnRenamed("n", "now").join(previous.withColumnRenamed("n", "before"), "source", "full").join(status.select("source", F.col("ok").cast("date").alias("last_ok"), F.col("n").alias("last_n")), "source", "left")
    out = out.withColumns({"now": F.coalesce("now", F.lit(0)), "before": F.coalesce("before", F.lit(0))})
    silent = broken(F.col("before"), F.col("now"))
    ok = F.coalesce("last_ok", t)
    verdict = F.when(~silent, "ok").when(F.datediff(t, ok) < days, "houd").otherwise("vervallen")
    return out.select("source", verdict.alias("verdict"), F.when(~silent, t).otherwise(ok).alias("ok"), F.when(~silent, F.col("now")).otherwise(F.coalesce("last_n", "before")).alias("n"))


def carry(current: DataFrame, previous: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Current events, where a source's previous events stand in for it while its verdict is to keep them."""
    held = verdicts.where("verdict = 'houd'").select("source")
    fresh = current.join(held, "source", "left_anti").withColumn("stale", F.lit(False))
    return fresh.unionByName(previous.join(held, "source", "left_semi").withColumn("stale", F.lit(True)), allowMissingColumns=True)


def accept_handover(items: DataFrame, today: str, max_age: int = 21, most: int = 5000) -> DataFrame:
    """items(source, handed, event struct or columns): hand-overs of at most ``max_age`` days and ``most`` items a source, not over."""
    t = F.lit(today).cast("date")
    sizes = items.groupBy("source").agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select("source")
    ok = (F.datediff(t, F.to_date("handed")) <= max_age) & (F.coalesce("end", "date") >= t)
    return items.where(ok).join(sizes, "source", "left_semi")


def not_sent(hits: DataFrame, sent: DataFrame, today: str, days: int = 60) -> DataFrame:
    """Hits without a message in the last ``days`` days; sent(id, date)."""
    live = sent.where(F.datediff(F.lit(today).cast("date"), F.col("date").cast("date")) <= days).select("id").distinct()
    return hits.join(live, "id", "left_anti")


def alert_digest(hits: DataFrame, single: int = 8, listed: int = 15) -> DataFrame:
    """hits(id, ord, line) -> (message, n): a message each for up to ``single`` hits, else one that lists the first."""
    n = hits.agg(F.count("*").alias("n"))  # one row
    both = hits.crossJoin(F.broadcast(n))
    each = both.where(F.col("n") <= single).select(F.col("line").alias("message"), F.lit(1).cast("bigint").alias("n"))
    first = both.where(F.col("n") > single).orderBy("ord").limit(listed)
    one = first.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("message")).select("message", "n")
    return each.unionByName(one)


def refetch_worklist(links: DataFrame, cache: DataFrame, today: str, version: int, max_age: int = 7, soon: int = 14) -> DataFrame:
    """links(url) that the page cache(url, at, v, next_date) lacks, has in another version or too old, or whose event is near."""
    t = F.lit(today).cast("date")
    out = links.join(cache, "url", "left")
    age = F.datediff(t, F.col("at").cast("date"))
    near = (F.datediff(F.col("next_date").cast("date"), t) <= soon) & (age > 0)
    stale = F.col("at").isNull() | (F.col("v") != version) | (age > max_age) | F.coalesce(near, F.lit(False))
    return out.where(stale).select("url")


def expire(cache: DataFrame, today: str, days: int = 30, column: str = "at") -> DataFrame:
    return cache.where(F.datediff(F.lit(today).cast("date"), F.col(column).cast("date")) <= days)


def upsert(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The cache with fresh rows in the place of those with their key."""
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def lookup_worklist(artists: DataFrame, cache: DataFrame, today: str, retry: int = 30, budget: int = 2500) -> DataFrame:
    """artists(key, first_date) to look up: never found, or not found over ``retry`` days ago; soonest first, within the budget."""
    t = F.lit(today).cast("date")
    out = artists.join(cache.select("key", "artist_id", F.col("t").cast("date").alias("tried")), "key", "left")
    due = F.col("tried").isNull() | (F.col("artist_id").isNull() & (F.datediff(t, "tried") >= retry))
    return out.where(due).select("key", "first_date").orderBy("first_date", "key").limit(budget)


def artists(events: DataFrame) -> DataFrame:
    """(key, name, first_date) of the acts: the first name seen and the earliest date."""
    from ..functions.keys import acts, artist_key

    rows = events.select("ord", "date", F.posexplode(acts(F.col("title"))).alias("p", "name")).withColumn("key", artist_key("name")).where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("name", F.struct("ord", "p")).alias("name"), F.min("date").alias("first_date"))


def gate(cleaned: DataFrame, previous_count: int, max_dropped: float = 0.03, least_share: float = 0.5) -> DataFrame:
    """One row: whether the snapshot may be published, and why not. cleaned has ``reason``."""
    c = cleaned.agg(F.count("*").alias("n_in"), F.count_if(F.col("reason").isNull()).alias("n_out"))
    verdict = F.when(F.col("n_out") == 0, "leeg").when((F.col("n_in") - F.col("n_out")) > max_dropped * F.col("n_in"), "te veel afgekeurd").when(F.col("n_out") < least_share * previous_count, "te weinig items").otherwise("ok")
    return c.select("n_in", "n_out", verdict.alias("verdict"))


def snapshot_before(snapshots: DataFrame, today: str, days: int = 6) -> DataFrame:
    """Rows of the latest snapshot_date at least ``days`` days ago, else of the oldest."""
    t = F.lit(today).cast("date")
    pick = snapshots.agg(F.coalesce(F.max(F.when(F.datediff(t, "snapshot_date") >= days, F.col("snapshot_date"))), F.min("snapshot_date")).alias("snapshot_date"))
    return snapshots.join(F.broadcast(pick), "snapshot_date")  # one row
