"""Queries of staging over items of every shape, made of the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import staging as S
from .binding import table

DOCUMENTS, MOST = 40, 200


def _item() -> Column:
    """An event as JSON text; one in twenty-four kinds of it is sound, the others have one value of a wrong shape."""
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 24
    day = F.date_format("ts", "yyyy-MM-dd")
    good = {
        "id": F.concat(F.lit('"e'), i, F.lit('"')), "v": F.concat(F.lit('"v'), (F.col("user_id") % 10).cast("string"), F.lit('"')), "title": F.concat(F.lit('"  act  '), i, F.lit('\\u0007"')), "date": F.concat(F.lit('"'), day, F.lit('"')),
        "time": F.lit('"20:15"'), "price": F.format_string("%.2f", "value"), "url": F.concat(F.lit('"https://x.example/a b/'), i, F.lit('"')), "status": F.lit('"sold"'), "kids": F.lit("true"), "dur": F.lit("90"), "support": F.lit('["a",1,"b"]'), "times": F.lit("[]"), "ook": F.lit("null"), "more": F.lit('{"x":[1]}'),
    }
    bad = {5: ("id", "5"), 6: ("id", '"a b"'), 7: ("v", "null"), 8: ("title", "true"), 9: ("title", "7"), 10: ("title", '" \\u200b "'), 11: ("date", "20240101"), 12: ("date", '"2024-13-01"'), 13: ("price", "true"), 14: ("price", '"12"'), 15: ("v", '"v-unknown"'), 16: ("time", '"24:00"'), 17: ("kids", "1"), 18: ("support", '"a"'),
           19: ("times", '[{"a":"one","s":"20:00"},{"a":"two"},5,{"a":3,"s":"21:00"},{"a":"four","s":"23:30"}]'), 20: ("ook", '[{"v":"v1","url":"ftp://x"},{"v":"v-none"},{"v":2},{"v":"v2","url":"https://y.example"}]'), 21: ("dur", "1441"), 22: ("url", "[]"), 23: ("status", '"gone"')}
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    fields = [member(n, F.coalesce(*(F.when(k == at, b) for at, (name, b) in bad.items() if name == n), c) if any(name == n for name, _ in bad.values()) else c) for n, c in good.items()]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return F.when(k == 1, "5").when(k == 2, '"text"').when(k == 3, "null").when(k == 4, "[{}]").otherwise(whole)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % DOCUMENTS).alias("doc"), "event_id", _item().alias("item"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]), ",")
    venues = ",".join([*(f'"v{k}":{{"name":"Hall {k}","lat":{k},"lon":true}}' for k in range(10)), '"v-none":{"name":""}', '"bad id":{"name":"x"}', '"v-text":"x"'])
    return e.groupBy("doc").agg(F.concat(F.lit(f'{{"venues":{{{venues}}},"events":['), listed, F.lit("]}")).alias("text")).select("doc", F.try_parse_json("text").alias("document"))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document is read once, for its venues and for its items
    docs = _documents(spark, sf_dir)
    return S.staged(S.document_items(docs, "doc"), S.document_venues(docs, "doc"), "doc", "2024-01-10", MOST)


_STAGED_SQL = f"""
    WITH e AS (SELECT event_id % {DOCUMENTS} AS doc, row_number() OVER (PARTITION BY event_id % {DOCUMENTS} ORDER BY event_id) - 1 AS ord, event_id % 24 AS k, * FROM events),
    r AS (SELECT *, CASE WHEN ord >= {MOST} THEN 'te veel items' WHEN k BETWEEN 1 AND 4 THEN 'geen object' WHEN k IN (5, 6) THEN 'id' WHEN k = 7 THEN 'podium-id' WHEN k BETWEEN 8 AND 10 THEN 'titel' WHEN k IN (11, 12) THEN 'datum' WHEN k = 15 THEN 'onbekend podium' END AS reason FROM e)"""


@query("f06c_staged_items", f"""{_STAGED_SQL} SELECT doc, ord, concat('e', event_id) AS id, concat('act ', event_id) AS title, CAST(ts AS DATE) AS date, CASE WHEN k <> 16 THEN '20:15' END AS time, CASE WHEN k NOT IN (13, 14) THEN round(value, 2) END AS price, CASE WHEN k <> 22 THEN concat('https://x.example/a%20b/', event_id) ELSE '' END AS url,
    CASE WHEN k <> 23 THEN 'sold' END AS status, CASE WHEN k <> 17 THEN true END AS kids, CASE WHEN k <> 21 THEN 90 END AS dur, CASE WHEN k <> 18 THEN 'a,b' END AS support, CASE WHEN k = 19 THEN 'one 20:00,four 23:30' END AS times, CASE WHEN k = 20 THEN CASE user_id % 10 WHEN 1 THEN 'v2 https://y.example' WHEN 2 THEN 'v1 ' ELSE 'v1 ,v2 https://y.example' END END AS ook FROM r WHERE reason IS NULL""")
def f06c(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return S.accepted(_staged(spark, sf_dir)).select(
        "doc", "ord", "id", "title", "date", "time", "price", "url", "status", "kids", "dur", F.array_join("support", ",").alias("support"), joined("times", lambda x: F.concat_ws(" ", x["a"], x["s"])).alias("times"), joined("ook", lambda x: F.concat(x["v"], F.lit(" "), x["url"])).alias("ook")
    )


@query("f06d_quarantine", f"{_STAGED_SQL} SELECT doc, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY doc, reason")
def f06d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quarantine(_staged(spark, sf_dir), "doc")


@query("f01_source_items", """SELECT event_id, CASE WHEN event_id % 24 BETWEEN 1 AND 4 OR event_id % 24 IN (8, 9, 11, 22) THEN 'titel, datum of url ontbreekt' WHEN event_id % 24 = 12 THEN 'ongeldige datum' END AS reason, CASE WHEN event_id % 24 NOT IN (1, 2, 3, 4, 16) THEN '20:15' END AS time, CASE WHEN event_id % 24 NOT IN (1, 2, 3, 4, 11, 12) THEN CAST(ts AS DATE) END AS date FROM events""")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select(F.lit("s").alias("source"), F.col("event_id").alias("place"), F.try_parse_json(_item()).alias("item"))
    return S.source_items(items).select(F.col("place").alias("event_id"), "reason", "time", "date")
