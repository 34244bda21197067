"""Links of pages, sitemaps of sitemaps, and nested offers.

References are resolved as columns. A tree of sitemaps is a fixpoint over the captured documents: each round joins the
maps found last with the edges of their documents. Offers of any depth are walked as variants, a few levels in place
and what lies deeper in further rounds over the rows that have it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.extract import HIGHEST, LOWEST, NO_TICKET, bare_amount, without_marks
from ..functions.keys import unescape
from ..sources.storage import durable

#: Addresses that look like an event's page, and addresses that never are one.
DETAIL = (
    r"(?i)/(agenda|programma|programme|event|events|evenement|evenementen|concert|concerten|film|films|movies?|voorstelling|voorstellingen|show|shows|"
    r"tentoonstelling|tentoonstellingen|exhibition|exhibitions|activiteit|activiteiten|nu-te-zien|productie|producties)/[^?#]{3,}"
)
SKIP = r"(?i)\.(jpe?g|png|gif|svg|pdf|ics|zip|mp[34])$|/(order|bestellen|checkout|winkelmand|basket)/|/(tag|categor(y|ie)|genre|page|zoeken|search|filter|nieuws|news|login|account|winkelwagen|cart)/|[?&](page|filter|genre)="
#: Sitemaps that are read for a site.
MAX_MAPS = 25

_TAG_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def visible_markup(html: Column) -> Column:
    """The page without comments and scripts, whose links are none."""
    return F.regexp_replace(html, r"(?is)<!--.*?(?:-->|$)|<script\b.*?</script\s*>", "")


def tags(html: Column, name: str) -> Column:
    """All opening tags of a name (a pattern)."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}(?=[\s>/]){_TAG_REST}"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not, with its references decoded; null without the attribute."""
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    return F.when(tag.rlike(pattern), U.let(value, lambda v: F.when(v.contains("&"), unescape(v)).otherwise(v)))


def base_of(html: Column, url: Column) -> Column:
    """What relative links of a page start from: its first ``base`` with an address, itself resolved, else the page."""
    found = F.filter(F.transform(tags(html, "base"), lambda t: attribute(t, "href")), lambda x: x.isNotNull())
    return U.let(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")), lambda b: F.when(b != "", U.resolve(url, b)).otherwise(url))


def wanted(url: Column, pattern: Column | str | None) -> Column:
    """Whether an address looks like an event's page; with a pattern of the source's own its query counts as well. A
    pattern column may be null on some rows."""
    path = U.part(url, U.PATH)
    if pattern is None:
        return path.rlike(DETAIL)
    own = F.lit(pattern) if isinstance(pattern, str) else pattern
    full = F.concat(path, F.when(U.part(url, U.QUERY) != "", F.concat(F.lit("?"), U.part(url, U.QUERY))).otherwise(""))
    return F.when(own.isNull(), path.rlike(DETAIL)).otherwise(F.regexp_like(full, F.concat(F.lit("(?i)"), own)))


def detail_links(pages: DataFrame, pattern: Column | str | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """pages(url, html) -> (url, link, place): links to event pages of the page's own host, each once, in order.

    ``attributes`` are further ones that hold links, on any element; they come after the anchors. Links start from the
    page's base, lose their fragment and aren't the page itself.
    """
    rows = pages.select("url", once(visible_markup(F.coalesce("html", F.lit("")))).alias("html"), (F.lit(pattern) if pattern is None or isinstance(pattern, str) else pattern).cast("string").alias("pattern"))
    found = lambda of, name: F.filter(F.transform(tags(F.col("html"), of), lambda t: attribute(t, name)), lambda x: x.isNotNull())
    hrefs = F.concat(found("a", "href"), *(found("[a-z][a-z0-9-]*", a) for a in attributes))
    rows = rows.select("url", "pattern", "html", once(base_of(F.col("html"), F.col("url"))).alias("base")).select("url", "pattern", "base", F.posexplode(hrefs).alias("place", "href"))
    rows = rows.select("url", "pattern", "place", once(U.without_fragment(U.resolve(F.col("base"), F.col("href")))).alias("link"))
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    same = (U.host(F.col("link")) == U.host(F.col("url"))) & (bare(F.col("link")) != bare(U.without_fragment(F.col("url"))))
    kept = rows.where(same & ~F.col("link").rlike(SKIP)).where(wanted(F.col("link"), F.col("pattern") if pattern is not None else None))
    return kept.groupBy("url", "link").agg(F.min("place").alias("place"))


def further_pages(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, link, place): the page named as next (a link element before an anchor), then numbered
    pages of the same listing: ``?page=2`` and the like of the same path, or ``/page/2/``; each once."""
    numbered = r"[?&](page|pagina|p)=\d+$|/page/\d+/?$"
    rows = pages.select("url", once(visible_markup(F.coalesce("html", F.lit("")))).alias("html"))
    is_next = lambda t: F.coalesce(F.concat(F.lit(" "), F.lower(attribute(t, "rel")), F.lit(" ")).rlike(r"\snext\s"), F.lit(False))
    named = F.concat(*(F.slice(F.filter(tags(F.col("html"), of), is_next), 1, 1) for of in ("link", "a")))
    anchors = F.filter(F.transform(tags(F.col("html"), "a"), lambda t: attribute(t, "href")), lambda x: x.isNotNull())
    rows = rows.select("url", once(F.try_element_at(named, F.lit(1))).alias("tag"), once(anchors).alias("anchors"))
    full = F.filter(F.transform("anchors", lambda h: U.without_fragment(U.resolve(F.col("url"), h))), lambda u: u.rlike(numbered))
    rows = rows.select("url", "anchors", once(attribute(F.col("tag"), "href")).alias("first"))
    rows = rows.select("url", "first", once(full).alias("full"))
    listing = lambda u: F.regexp_replace(F.regexp_replace(U.part(u, U.PATH), r"/page/\d+/?$", ""), "/+$", "")
    first = F.col("first")
    own = F.filter("full", lambda u: (U.part(u, U.AUTHORITY) == U.part(F.col("url"), U.AUTHORITY)) & (listing(u) == F.regexp_replace(U.part(F.col("url"), U.PATH), "/+$", "")))
    links = F.array_distinct(F.concat(F.filter(F.array(F.when(F.coalesce(first, F.lit("")) != "", U.resolve(F.col("url"), first))), lambda x: x.isNotNull()), own))
    return rows.select("url", F.posexplode(links).alias("place", "link"))


def once(c: Column) -> Column:
    """The same value through a one-element explode: the optimizer doesn't copy a long expression to wherever it is used."""
    return F.explode(F.array(c))


def _entries(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?is)<{name}\b.*?</{name}>"), F.lit(0))


def _inside(entry: Column, name: str) -> Column:
    """The trimmed text of an element; null where there is none."""
    pattern = rf"(?is)<{name}>\s*(.*?)\s*</{name}>"
    return F.when(entry.rlike(pattern), F.regexp_extract(entry, pattern, 1))


def sitemap_documents(maps: DataFrame) -> DataFrame:
    """Documents (url, xml), a null one empty -> (map, xml), one an address."""
    return maps.groupBy(F.col("url").alias("map")).agg(F.min(F.coalesce("xml", F.lit(""))).alias("xml"))


def sitemap_children(documents: DataFrame) -> DataFrame:
    """The maps that each document names (map, place, child)."""
    children = documents.select("map", F.posexplode(_entries(F.col("xml"), "sitemap")).alias("place", "e")).select("map", "place", once(_inside(F.col("e"), "loc")).alias("child"))
    return children.where(F.col("child").isNotNull() & ~F.col("child").endswith(".gz")).withColumn("child", unescape("child"))


def sitemap_links(documents: DataFrame) -> DataFrame:
    """The links of each document (map, place, link, lastmod)."""
    links = documents.select("map", F.posexplode(_entries(F.col("xml"), "url")).alias("place", "e"))
    links = links.select("map", "place", "e", once(_inside(F.col("e"), "loc")).alias("link")).where("link is not null")
    decoded = F.when(F.col("link").contains("&"), unescape("link")).otherwise(F.col("link"))
    return links.select("map", "place", once(U.without_fragment(decoded)).alias("link"), F.coalesce(_inside(F.col("e"), "lastmod"), F.lit("")).alias("lastmod"))


def maps_of_sites(sites: DataFrame, children: DataFrame, max_maps: int = MAX_MAPS) -> DataFrame:
    """sites(site, url) -> (site, map, turn): the first ``max_maps`` maps of each site in breadth-first order.

    A map is visited once however often it is named; one without a document counts, as it had to be asked for. Rounds
    end when no site finds a new map: at the deepest chain of maps, max_maps rounds at most.
    """
    frontier = durable(sites.select("site", F.col("url").alias("map"), F.lit(0).cast("long").alias("turn")).distinct())
    visited = frontier
    for _ in range(max_maps):
        named = frontier.join(children, "map").select("site", F.col("child").alias("map"), "turn", "place")
        new = named.groupBy("site", "map").agg(F.min(F.struct("turn", "place")).alias("at")).join(visited, ["site", "map"], "left_anti")
        sizes = visited.groupBy("site").agg(F.count("*").alias("before"))
        turn = F.col("before") + F.row_number().over(Window.partitionBy("site").orderBy("at")) - 1
        frontier = durable(new.join(sizes, "site").withColumn("turn", turn).where(F.col("turn") < max_maps).select("site", "map", "turn"))
        if frontier.isEmpty():
            break
        visited = durable(visited.unionByName(frontier))
    return visited


def sitemap_tree(sites: DataFrame, maps: DataFrame, pattern: Column | str | None = None, max_maps: int = MAX_MAPS) -> DataFrame:
    """sites(site, url) and documents (url, xml) -> (site, link, lastmod, rank): links of the site's own host, newest first.

    ``url`` is the site's first map. Of a link that several maps give the first one's date counts, in the order in which
    maps are visited; equal dates stay in that order, links without a date come last. Packed maps (.gz) are left out.
    """
    documents = sitemap_documents(maps)
    visited = maps_of_sites(sites, durable(sitemap_children(documents)), max_maps)
    # links of maps that no site visits aren't read
    links = sitemap_links(documents.join(visited.select("map").distinct(), "map", "left_semi")).where(wanted(F.col("link"), pattern))
    starts = sites.select("site", U.host(F.col("url")).alias("host")).distinct()
    rows = visited.join(links, "map").join(starts, "site").where(U.host(F.col("link")) == F.col("host"))
    first = rows.groupBy("site", "link").agg(F.min(F.struct("turn", "place", "lastmod")).alias("at"))
    order = Window.partitionBy("site").orderBy(F.desc("at.lastmod"), "at.turn", "at.place")
    return first.select("site", "link", F.col("at.lastmod").alias("lastmod"), F.row_number().over(order).alias("rank"))


#: Levels of nested offers that are walked in place; lists and objects count alike.
LEVELS = 4


def _children(node: Column) -> Column:
    """What a node leads to: a list's items, an object's offers and price specifications."""
    inner = F.filter(F.array(F.try_variant_get(node, "$.offers", "variant"), F.try_variant_get(node, "$.priceSpecification", "variant")), lambda x: x.isNotNull())
    return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), inner)


def _asked(node: Column) -> Column:
    """(price, free) of an object node: the amount it asks in EUR for a ticket, and whether it says that it is free."""
    text = lambda name: F.try_variant_get(node, f"$.{name}", "string")
    words = F.concat_ws(" ", *(F.coalesce(text(n), F.lit("")) for n in ("name", "description", "category")))
    asks = lambda name: U.let(without_marks(text(name)), bare_amount)
    told = F.struct(F.coalesce(asks("lowPrice"), asks("price")).alias("price"), F.upper(F.coalesce(F.nullif(text("priceCurrency"), F.lit("")), F.lit("EUR"))).alias("currency"), words.alias("words"))

    def counted(x: Column) -> Column:
        counts = (x["currency"] == "EUR") & ~x["words"].rlike(NO_TICKET)
        return F.struct(F.when((x["price"] >= LOWEST) & (x["price"] <= HIGHEST) & counts, x["price"]).alias("price"), F.coalesce((x["price"] == 0) & counts & x["words"].rlike("(?i)gratis|free|vrij"), F.lit(False)).alias("free"))

    # an array function evaluates what it names as often as it names it
    return U.let(told, counted)


def walked_offers(rows: DataFrame, key: str, nodes: Column, *others: str) -> DataFrame:
    """(key, others, price, free, rest) of rows with ``nodes``, an array of variants: what LEVELS levels of them ask, and the nodes below."""
    out = rows.select(key, *others, once(nodes).alias("l0"))
    for k in range(LEVELS):
        out = out.select("*", once(F.flatten(F.transform(f"l{k}", _children))).alias(f"l{k + 1}"))
    asked = F.flatten(F.array(*(F.transform(f"l{k}", _asked) for k in range(LEVELS))))
    out = out.select(key, *others, once(asked).alias("asked"), F.col(f"l{LEVELS}").alias("rest"))
    asked = F.col("asked")
    return out.select(key, *others, F.array_min(F.filter(F.transform(asked, lambda x: x["price"]), lambda p: p.isNotNull())).alias("price"), F.exists(asked, lambda x: x["free"]).alias("free"), "rest")


def event_prices(events: DataFrame, key: str, payload: str) -> DataFrame:
    """Events as JSON-LD, one row a ``key`` -> (key, price): the lowest EUR price in 1..500 of all their offers.

    Offers nest in lists, offers and price specifications to any depth. 0 if the event is accessible for free, or if an
    offer of 0 says so; null without a price, and for payloads that are no JSON.
    """
    rows = events.select(key, once(F.try_parse_json(payload)).alias("event"))
    open_door = F.lower(F.try_variant_get("event", "$.isAccessibleForFree", "string")).isin("true", "https://schema.org/true")
    start = F.filter(F.array(F.try_variant_get("event", "$.offers", "variant")), lambda x: x.isNotNull())
    rows = rows.select(key, F.coalesce(open_door, F.lit(False)).alias("open"), start.alias("start"))
    first = found = durable(walked_offers(rows, key, F.col("start"), "open"))
    parts = []
    while not (deeper := found.where(F.size("rest") > 0)).isEmpty():  # one round for each LEVELS levels, over the rows that go on
        found = durable(walked_offers(deeper, key, F.col("rest")))
        parts.append(found.select(key, F.col("price").alias("_price"), F.col("free").alias("_free")))
    price, free = F.col("price"), F.col("free")
    if parts:
        below = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min("_price").alias("_price"), F.bool_or("_free").alias("_free"))
        first = first.join(below, key, "left")
        price, free = F.least(price, "_price"), free | F.coalesce("_free", F.lit(False))
    return first.select(key, F.when(F.col("open"), 0.0).otherwise(F.coalesce(price, F.when(free, 0.0))).alias("price"))
