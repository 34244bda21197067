"""Queries of links, sitemaps and nested offers over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import web as W
from .binding import table


@query("x18b_links_resolved", """
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?:)', 1) AS scheme, regexp_extract(url, '^https?:(//[^/?#]*)', 1) AS host, regexp_extract_all(html, '<a href="(/[^"#]+)"', 1) AS links FROM pages),
    x AS (SELECT page_id, url, scheme, host, unnest(links) AS w, unnest(range(len(links))) AS place FROM p),
    r AS (SELECT page_id, url, place, CASE page_id % 5 WHEN 0 THEN concat(scheme, host, w) WHEN 1 THEN concat(scheme, host, '/b', w) WHEN 2 THEN concat(scheme, host, '/b/c', w) WHEN 3 THEN concat(scheme, host, '/x', w) ELSE concat(scheme, host, w, '?a=1&b=2') END AS link FROM x)
    SELECT page_id, link, min(place) AS place FROM r WHERE link <> regexp_replace(string_split(url, '#')[1], '/+$', '') GROUP BY page_id, link""")
def x18b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' links, written with dots, a base of the page, another scheme or host part, queries and fragments."""
    host = F.regexp_extract("url", "^https?:(//[^/?#]*)", 1)
    k = F.col("page_id") % 5
    as_href = lambda before, after="": F.regexp_replace("html", '<a href="(/[^"#]+)"', F.concat(F.lit("<a class=x href="), before, F.lit("$1"), F.lit(after)))
    base = lambda b: F.concat(F.lit('<base target="_top"><base href="'), b, F.lit('">'))
    html = (
        F.when(k == 0, as_href(F.lit('"/x/..'), '"')).when(k == 1, F.concat(base(F.lit("/b/c/")), as_href(F.lit("' .."), "'"))).when(k == 2, F.concat(base(F.concat(host, F.lit("/b/c/d"))), as_href(F.lit('".'), '"')))
        .when(k == 3, as_href(F.concat(F.lit('"'), host, F.lit("/x/./y/..")), '"')).otherwise(as_href(F.lit('"'), '?a=1&amp;b=2#top"'))
    )
    # one page an address, so that links come back by page
    pages = table(spark, sf_dir, "pages").where("url is not null").select("page_id", "url", html.alias("html"))
    found = W.detail_links(pages.select(F.concat_ws("#", F.split("url", "#")[0], F.col("page_id").cast("string")).alias("url"), "html"), ".*")
    return found.select(F.substring_index("url", "#", -1).cast("long").alias("page_id"), "link", "place")


@query("x20b_further_pages", """
    WITH c AS (SELECT c_custkey AS k, concat('https://x.example/list/', c_custkey) AS u FROM customer)
    SELECT u AS url, unnest(l) AS link, unnest(range(len(l))) AS place FROM (SELECT u, CASE k % 5 WHEN 0 THEN [concat(u, '?page=2'), concat(u, '/page/3/')] WHEN 1 THEN ['https://x.example/next/a?x=1', concat(u, '?p=2')]
        WHEN 2 THEN ['https://x.example/list/b', concat(u, '?p=3')] WHEN 3 THEN [concat(u, '?a=1&pagina=2')] ELSE [] END AS l FROM c) x""")
def x20b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    html = (
        F.when(k % 5 == 0, F.concat(F.lit('<a href="?page=2">2</a><a href="/other?page=9">no</a><a href="./'), key, F.lit('/page/3/#x">3</a><a href="/list/'), key, F.lit('?page=2">again</a><!-- <a href="?page=7">7</a> -->')))
        .when(k % 5 == 1, F.lit("<a rel=next href='/wrong'>a</a><a href='?p=2'>2</a><link href='/next/y/../a?x=1' rel='x next'>"))
        .when(k % 5 == 2, F.concat(F.lit('<a class="x" rel="next" href="b">next</a><a href="https://x.example/list/'), key, F.lit('?p=3">3</a><a href="https://www.x.example/list/'), key, F.lit('?p=4">4</a>')))
        .when(k % 5 == 3, F.lit('<a href="?a=1&amp;pagina=2">2</a><a href="?pagina=2&amp;a=1">no</a><a href="/page/2">other list</a>')).otherwise("<p>one page</p>")
    )
    return W.further_pages(table(spark, sf_dir, "customer").select(F.concat(F.lit("https://x.example/list/"), key).alias("url"), html.alias("html")))


def _sitemaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Forty sites whose first map names a map a year, and those a map a month, with loops, packed maps and links of others."""
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("site"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), d.alias("d"), F.year(d).alias("y"), F.date_format(d, "yyyy-MM").alias("m"))
    at = lambda rest: F.concat(F.lit("https://www.s"), F.col("site").cast("string"), F.lit(".example/"), rest)
    named = lambda u: F.concat(F.lit("<sitemap a='1'><loc>\n"), u, F.lit(" </loc></sitemap>"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "")
    root = at(F.lit("sitemap.xml"))
    roots = o.groupBy("site").agg(joined(named(at(F.concat(F.lit("y"), F.col("y").cast("string"), F.lit(".xml"))))).alias("x")).select(root.alias("url"), F.concat(F.lit("<sitemapindex>"), "x", named(root), named(at(F.lit("old.xml.gz"))), F.lit("</sitemapindex>")).alias("xml"))
    years = o.groupBy("site", "y").agg(joined(named(at(F.concat(F.lit("m"), "m", F.lit(".xml"))))).alias("x")).select(at(F.concat(F.lit("y"), F.col("y").cast("string"), F.lit(".xml"))).alias("url"), F.concat(F.lit("<sitemapindex>"), named(root), "x", F.lit("</sitemapindex>")).alias("xml"))
    own = F.concat(F.lit("https://s"), F.col("site").cast("string"), F.lit(".example/show/"))
    dated = F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("<lastmod> "), F.col("d").cast("string"), F.lit("</lastmod>")))
    entry = F.concat(F.lit("<url><loc>"), own, F.lit("ord"), F.col("k").cast("string"), F.lit("?a=1&amp;b=2#x</loc>"), dated, F.lit("</url><URL x='1'>\n<loc>"), own, F.lit("cus"), F.col("c").cast("string"), F.lit("</loc><lastmod>"), F.col("d").cast("string"), F.lit("</lastmod></URL><url><loc>https://other.example/show/1234</loc></url>"))
    months = o.groupBy("site", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))), lambda x: x["e"]), "").alias("x")).select(at(F.concat(F.lit("m"), "m", F.lit(".xml"))).alias("url"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("xml"))
    sites = o.select("site").distinct().select("site", root.alias("url"))
    return sites, roots.union(years).union(months)


_TREE_SQL = """
    WITH RECURSIVE o AS (SELECT o_custkey % 40 AS site, o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d FROM orders),
    edges AS (SELECT DISTINCT site, 'root' AS map, concat('y', year(d)) AS child FROM o UNION SELECT site, 'root', 'root' FROM o UNION SELECT site, concat('y', year(d)), 'root' FROM o UNION SELECT site, concat('y', year(d)), concat('m', strftime(d, '%Y-%m')) FROM o),
    walk AS (SELECT DISTINCT site, 'root' AS map, 0 AS level, '' AS trail FROM o UNION SELECT w.site, child, level + 1, concat(trail, '/', child) FROM walk AS w JOIN edges AS e ON w.site = e.site AND w.map = e.map WHERE level < 4 AND child <> 'root'),
    turns AS (SELECT site, map, row_number() OVER (PARTITION BY site ORDER BY level, trail) AS turn FROM walk QUALIFY turn <= {most}),
    links AS (SELECT o.site, concat('https://s', o.site, '.example/show/ord', k, '?a=1&b=2') AS link, CASE WHEN k % 5 = 0 THEN '' ELSE CAST(d AS VARCHAR) END AS lastmod, turn, k, 0 AS n FROM o JOIN turns AS t ON o.site = t.site AND t.map = concat('m', strftime(d, '%Y-%m'))
        UNION ALL SELECT o.site, concat('https://s', o.site, '.example/show/cus', c), CAST(d AS VARCHAR), turn, k, 1 FROM o JOIN turns AS t ON o.site = t.site AND t.map = concat('m', strftime(d, '%Y-%m'))),
    firsts AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY site, link ORDER BY turn, k, n) = 1)
    SELECT site, link, lastmod, row_number() OVER (PARTITION BY site ORDER BY lastmod DESC, turn, k, n) AS rank FROM firsts"""


@query("x19b_sitemap_tree", _TREE_SQL.format(most=200))
def x19b(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, maps = _sitemaps(spark, sf_dir)
    return W.sitemap_tree(sites, maps, max_maps=200)


@query("x19c_first_sitemaps", _TREE_SQL.format(most=25))
def x19c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many maps as are read of a site by default."""
    sites, maps = _sitemaps(spark, sf_dir)
    return W.sitemap_tree(sites, maps, pattern="^/show/(ord|cus)")


@query("x09b_nested_offers", """
    WITH p AS (SELECT l_orderkey AS k, CASE WHEN floor(l_extendedprice / 100) BETWEEN 1 AND 500 THEN floor(l_extendedprice / 100) END AS price FROM lineitem)
    SELECT k, CASE k % 6 WHEN 4 THEN 0 WHEN 5 THEN coalesce(min(price), 0) ELSE min(price) END AS price FROM p GROUP BY k""")
def x09b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers in lists of lists, in price specifications, nine objects deep, beside fees and beside what is free."""
    p, k = F.floor(F.col("l_extendedprice") / 100).cast("string"), F.col("l_orderkey") % 6
    item = F.when(k == 0, F.concat(F.lit('[{"price":'), p, F.lit('},"x",null]'))).when(k == 5, F.concat(F.lit('{"lowPrice":"'), p, F.lit(',-","price":"1"}'))).otherwise(F.concat(F.lit('{"@type":"Offer","price":"€ '), p, F.lit('","priceCurrency":"eur"}')))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("list"))
    deep = lambda inner, n: F.concat(F.lit('{"offers":' * n), inner, F.lit("}" * n))
    event = (
        F.when(k == 1, F.concat(F.lit('{"offers":{"price":"x","priceSpecification":'), "list", F.lit("}}"))).when(k == 2, deep(F.col("list"), 9))
        .when(k == 3, F.concat(F.lit('{"offers":[{"category":"Servicekosten","price":"2"},{"price":"3","priceCurrency":"USD"},{"offers":'), "list", F.lit("}]}")))
        .when(k == 4, F.concat(F.lit('{"isAccessibleForFree":true,"offers":'), "list", F.lit("}"))).when(k == 5, F.concat(F.lit('{"offers":[{"price":0,"name":"Gratis"},'), "list", F.lit("]}"))).otherwise(deep(F.col("list"), 1))
    )
    return W.event_prices(li.select(F.col("l_orderkey").alias("k"), event.alias("event")), "k", "event")
