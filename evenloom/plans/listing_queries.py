"""Queries of listings, festivals and tagged payloads over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import listings as P
from .binding import AGENDA_SQL, agenda, table
from .extract_queries import _month

FULL = ("maandag", "dinsdag", "woensdag", "donderdag", "vrijdag", "zaterdag", "zondag")


@query("x31_listing_labels", "SELECT concat('p', event_id) AS id, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS time, concat('act ', event_id) AS title, 'Zaal, Noord' AS venue, 'Breda' AS city, CASE WHEN event_id % 6 = 0 THEN 'sold' END AS status FROM events")
def x31(spark, sf_dir):
    d = F.to_date("ts")
    n = F.col("event_id").cast("string")
    wd = F.element_at(F.array(*(F.lit(w) for w in FULL)), F.weekday(d) + 1)
    label = F.concat(F.lit("Concert act "), n, F.lit(", "), wd, F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(" "), _month(d), F.lit(" "), F.year(d).cast("string"), F.lit(" om "), F.date_format("ts", "HH:mm"), F.lit(", Zaal, Noord, Breda, "), F.when(F.col("event_id") % 6 == 0, "uitverkocht").otherwise("tickets beschikbaar"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), F.concat(F.lit("/concert/"), n, F.lit("/act")).alias("href"), F.concat(F.lit("Concert act "), n, F.lit(" in Zaal, Noord")).alias("title"), label.alias("label"))
    return P.listing_labels(rows.unionByName(rows.withColumn("place", F.col("place") + 10_000_000))).select("id", "date", "time", "title", "venue", "city", "status")


@query("x15_heading_or_name", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Agenda overzicht' END AS title FROM part")
def x15(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    url = F.concat(F.lit("https://x.example/"), F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise("iets"))
    return p.select("p_partkey", P.pick_by_address(F.col("p_name"), F.lit("Agenda overzicht"), url).alias("title"))


@query("x26_skip_words", "SELECT p_partkey FROM part WHERE NOT contains(p_name, 'ring') AND NOT contains(p_name, 'bolt')")
def x26(spark, sf_dir):
    return P.skip_words(table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("title")), ["ring", "bolt"]).select("p_partkey")


@query("x32_exhibition_title", "SELECT p_partkey, upper(p_name) AS title FROM part")
def x32(spark, sf_dir):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit("14.06-27.09.2026 "), F.upper("p_name"))).when(k == 1, F.concat(F.lit("21 mei t/m 5 juli 2026 | "), F.upper("p_name"))).otherwise(F.upper("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", P.exhibition_title(t).alias("title"))


@query("x05_festival_periods", """WITH e AS (SELECT o_custkey AS source, CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + 2 AS e FROM orders WHERE o_custkey % 3 = 0 AND CAST(o_orderdate AS DATE) + 2 >= DATE '1996-01-01')
    SELECT source, min(date) AS start, max(e) AS "end" FROM e GROUP BY source UNION ALL SELECT DISTINCT o_custkey, DATE '1996-06-05', DATE '1996-06-07' FROM orders WHERE o_custkey NOT IN (SELECT source FROM e)""")
def x05(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    events = o.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("source"), d.alias("date"), F.date_add(d, 2).alias("end"), F.lit(None).cast("int").alias("month"))
    day = lambda s: F.lit(s).cast("date")
    texts = o.select(F.col("o_custkey").alias("source")).distinct()
    periods = texts.select("source", day("1996-06-05").alias("start"), day("1996-06-07").alias("end"), F.lit(6).alias("month")).union(texts.select("source", day("1996-01-01"), day("1996-04-01"), F.lit(6)))
    return P.festival_periods(events, periods, "1996-01-01")


@query("n05_tagged_json", "SELECT concat('c', o_custkey) AS source, count(*) AS productions FROM orders GROUP BY 1")
def n05(spark, sf_dir):
    item = F.concat(F.lit('[0,{"title":[0,"'), F.col("o_orderkey").cast("string"), F.lit('"],"screenings":[1,[[0,{"id":[0,1]}]]]}]'))
    rows = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source")).agg(F.concat(F.lit('{"productions":[1,['), F.array_join(F.collect_list(item), ","), F.lit("]]}")).alias("j"))
    return P.untagged(rows, "j", "screenings").groupBy("source").agg(F.count("*").alias("productions"))


@query("n06_date_lists", "SELECT o_custkey AS source, min(CAST(o_orderdate AS DATE)) AS start, max(CAST(o_orderdate AS DATE)) AS \"end\" FROM orders GROUP BY 1")
def n06(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).alias("d"))
    return P.date_lists(rows, "d").select("source", "start", "end")


@query("n07_cards", "SELECT o_custkey AS url, CAST(o_orderkey AS VARCHAR) AS link, timezone('Europe/Amsterdam', timezone('UTC', o_orderdate)) AS start FROM orders")
def n07(spark, sf_dir):
    card = F.concat(F.lit('<li class="card"><a href="/e/'), F.col("o_orderkey").cast("string"), F.lit('" data-start="'), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit('">x</a></li>'))
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("url")).agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(card), ""), F.lit("</ul>")).alias("html"))
    return P.cards(pages, '<li class="card">', {"link": 'href="/e/([^"]+)"', "start": 'data-start="([^"]+)"'}, "start")


@query("j13_alarm_hits", f"WITH {AGENDA_SQL} SELECT id, CASE WHEN contains(lower(concat_ws(' ', title, venue, city)), 'nation_1') THEN 'NATION_1' ELSE 'act 7' END AS word FROM agenda WHERE contains(lower(concat_ws(' ', title, venue, city)), 'nation_1') OR contains(lower(concat_ws(' ', title, venue, city)), 'act 7')")
def j13(spark, sf_dir):
    r = table(spark, sf_dir, "region").where("r_regionkey < 2")
    words = r.select(F.when(F.col("r_regionkey") == 0, "NATION_1").otherwise("act 7").alias("word"), F.col("r_regionkey").alias("place"))
    return P.alarm_hits(agenda(spark, sf_dir), words)


@query("j14_count_changes", "WITH n AS (SELECT o_custkey AS source, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS source, count(*) AS was FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT n.source, n, was, n - coalesce(was, 0) AS delta FROM n LEFT JOIN b ON n.source = b.source")
def j14(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("n"))
    return P.count_changes(n, o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("n")))
