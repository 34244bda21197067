"""The cascade of readers over pages of every kind, made of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import documents as D
from ..operators import listings as L
from ..operators import payload as P
from ..operators import readers as R
from .binding import table
from .document_queries import _jsonld
from .extract_queries import _month


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with structured data, with bad ones, with a list of showings, with an empty one, with text only, with nothing."""
    k, d, i = F.col("event_id") % 6, F.to_date("ts"), F.col("event_id").cast("string")
    head = F.concat(F.lit("<html><main><h1>act "), i, F.lit("</h1>"))
    text = F.concat(F.lit("<p>"), F.dayofmonth(d).cast("string"), F.lit(" "), _month(d), F.lit(" 2024</p><p>Aanvang: "), F.date_format("ts", "HH:mm"), F.lit("</p>"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+02:00")
    jsonld = lambda date: F.concat(F.lit('<script type="application/ld+json">{"@type":"Event","name":"json '), i, F.lit('","startDate":"'), date, F.lit('"}</script>'))
    show = lambda at, name: F.concat(F.lit('{"information":{"date":"'), d.cast("string"), F.lit(f'","time":"{at} uur","price":"€ 12,50"}},"link":{{"name":"{name}"}}}}'))
    shows = lambda items: F.concat(F.lit("""<component is="shows" :model='{"items":["""), items, F.lit("]}'></component>"))
    html = (
        F.when(k == 0, F.concat(jsonld(iso), head, text)).when(k == 1, F.concat(jsonld(F.lit("soon")), head, text)).when(k == 2, F.concat(head, shows(F.concat(show("20.15", "Bestel"), F.lit(","), show("9:30", "Uitverkocht"))), text))
        .when(k == 3, F.concat(head, shows(F.lit("")), text)).when(k == 4, F.concat(head, text)).otherwise(F.concat(head, F.lit("<p>nothing</p>")))
    )
    return table(spark, sf_dir, "events").select(F.concat(F.lit("https://x.example/"), i).alias("url"), F.concat(html, F.lit("</main></html>")).alias("html"))


@query("n09b_reader_cascade", """
    WITH e AS (SELECT event_id, event_id % 6 AS k, concat('https://x.example/', event_id) AS url, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS t FROM events)
    SELECT 'jsonld' AS reader, url, concat('json ', event_id) AS title, date, CASE WHEN t <> '00:00' THEN t END AS time, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS status FROM e WHERE k = 0
    UNION ALL SELECT 'shows', url, concat('act ', event_id), date, '20:15', 12.5, NULL FROM e WHERE k = 2 UNION ALL SELECT 'shows', url, concat('act ', event_id), date, '09:30', 12.5, 'sold' FROM e WHERE k = 2
    UNION ALL SELECT 'text', url, concat('act ', event_id), date, t, NULL, NULL FROM e WHERE k IN (1, 4)""")
def n09b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_pages(_pages(spark, sf_dir), "2024-01-05").select("reader", "url", "title", "date", "time", "price", "status")


@query("x04b_bare_periods", 'SELECT event_id, CAST(ts AS DATE) AS start, CAST(ts AS DATE) + CAST(event_id % 90 + 1 AS INTEGER) AS "end" FROM events')
def x04b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dates with bars or no more than a space between them."""
    a = F.to_date("ts")
    b, k = F.date_add(a, (F.col("event_id") % 90 + 1).cast("int")), F.col("event_id") % 5
    day = lambda c: F.concat_ws(" ", F.dayofmonth(c).cast("string"), _month(c), F.year(c).cast("string"))
    dotted = lambda c: F.date_format(c, "dd.MM.yyyy")
    text = (
        F.when(k == 0, F.concat(F.lit("Hal: "), day(a), F.lit(" | "), day(b))).when(k == 1, F.concat(dotted(a), F.lit(" "), dotted(b))).when(k == 2, F.concat(day(a), F.lit(" | | t/m | "), day(b), F.lit(" | 10:00")))
        .when(k == 3, F.concat(day(a), F.lit("  "), day(b))).otherwise(F.concat(dotted(a), F.lit("||"), dotted(b)))
    )
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return D.with_period(rows, "text", F.lit("2024-01-05").cast("date")).select("event_id", "start", "end")


@query("x24b_title_strip", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('act ', event_id) WHEN 1 THEN concat('act ', event_id, ' 2026') WHEN 2 THEN 'ab 2026' ELSE concat('act ', event_id) END AS title FROM events")
def x24b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern of the source's own, none, one that leaves too little, and one for what stands in front."""
    k, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    title = F.when(k < 2, F.concat(F.lit("act "), i, F.lit(" 2026"))).when(k == 2, "ab 2026").otherwise(F.concat(F.lit("Live: act "), i))
    strip = F.when(k == 3, "^LIVE:").when(k != 1, r"\s20\d\d$")
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("Hall").alias("source"), i.alias("url"), title.alias("title"), F.lit("2024-05-05").cast("date").alias("date"), F.lit(None).cast("date").alias("end"), F.lit("pop").alias("vtype"), F.lit("2023-12-20").cast("date").alias("_today"), strip.alias("title_strip"))
    return D.clean_titles(rows).select("event_id", "title")


@query("x12b_jsonld_values", """SELECT concat('https://x.example/', CAST(floor(event_id / 20) AS BIGINT)) AS url, concat('act ', event_id) AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') AS start, CASE WHEN event_id % 7 = 0 THEN 'https://schema.org/EventCancelled' END AS status, CAST(CAST(floor(value) + 1 AS BIGINT) AS VARCHAR) AS price FROM events""")
def x12b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects themselves, not their number."""
    of = lambda path: F.get_json_object("event", f"$.{path}")
    return D.jsonld_events(_jsonld(spark, sf_dir)).select("url", of("name").alias("name"), of("startDate").alias("start"), of("eventStatus").alias("status"), of("offers[0].price").alias("price"))


@query("n05b_tagged_values", "SELECT concat('c', o_custkey) AS source, CAST(o_orderkey AS VARCHAR) AS title, o_orderkey % 3 AS shows FROM orders")
def n05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Productions with none, one or two showings, as objects without their tags."""
    show = lambda k: F.concat(F.lit('[0,{"id":[0,'), F.lit(str(k)), F.lit("]}]"))
    shows = F.array_join(F.slice(F.array(show(1), show(2)), 1, (F.col("o_orderkey") % 3).cast("int")), ",")
    item = F.concat(F.lit('[0,{"title":[0,"'), F.col("o_orderkey").cast("string"), F.lit('"],"screenings":[1,['), shows, F.lit("]]}]"))
    rows = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source")).agg(F.concat(F.lit('{"productions":[1,['), F.array_join(F.collect_list(item), ","), F.lit("]]}")).alias("j"))
    return L.untagged(rows, "j", "screenings").select("source", F.get_json_object("object", "$.title").alias("title"), F.size(F.from_json(F.get_json_object("object", "$.screenings"), "array<struct<id:int>>")).alias("shows"))


@query("x21b_block_texts", """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, concat('<div class="accordion"><h3>', o_orderkey, '</h3></div>') AS block FROM orders""")
def x21b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in their order and as they stand."""
    block = F.concat(F.lit('<div class="accordion"><h3>'), F.col("o_orderkey").cast("string"), F.lit("</h3></div>"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), "")
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("url")).agg(F.concat(F.lit("<main>"), listed).alias("html"))
    return P.split_blocks(pages, '<div class="accordion">').select(F.col("url").alias("o_custkey"), F.col("place").cast("long").alias("place"), "block")
