"""Normalising nested payloads: JSON lists, productions with showings, embedded and tagged JSON, links, sitemaps.

Payloads are parsed with declared schemas or as variants and exploded, so Spark reads only the fields in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import amount, parse_iso


def flat_list(df: DataFrame, payload: str, schema: str, fields: dict[str, str], drop: str | None = None) -> DataFrame:
    """A JSON list per row -> a row per item with renamed fields; ``drop`` is a condition over the items' own fields."""
    items = df.withColumn("_x", F.explode(F.from_json(payload, f"array<struct<{schema}>>"))).select(*df.columns, "_x.*")
    if drop:
        items = items.where(f"not coalesce({drop}, false)")
    return items.select(*(F.col(a).alias(b) for a, b in fields.items()), *(c for c in df.columns if c != payload and c not in fields))


def two_level(df: DataFrame, payload: str, outer: str, inner: str, inner_name: str, prices: str | None = None) -> DataFrame:
    """Productions with showings (and a price list) -> a row per showing with its production's fields and lowest price."""
    schema = f"array<struct<{outer}, {inner_name}: array<struct<{inner}>>" + (f", {prices}: array<double>" if prices else "") + ">>"
    rows = df.withColumn("_p", F.explode(F.from_json(payload, schema)))
    low = F.array_min(F.filter(f"_p.{prices}", lambda p: (p >= 1) & (p <= 500))) if prices else F.lit(None).cast("double")
    rows = rows.withColumn("_s", F.explode_outer(f"_p.{inner_name}")).withColumn("price", low)
    names = [x.split(":")[0].strip() for x in outer.split(",")]
    return rows.select(*(c for c in df.columns if c != payload), *(F.col(f"_p.{n}").alias(n) for n in names), "_s.*", "price")


def joined(df: DataFrame, titles: str, shows: str, title_schema: str, show_schema: str, key: str) -> DataFrame:
    """A payload with a title map (by id) and a show list -> shows with their titles' fields."""
    t = df.select("source", F.explode(F.from_json(titles, f"map<string, struct<{title_schema}>>")).alias(key, "_t")).select("source", key, "_t.*")
    s = df.select("source", F.explode(F.from_json(shows, f"array<struct<{key}: string, {show_schema}>>")).alias("_s")).select("source", "_s.*")
    return s.join(t, ["source", key])


def duration(start: Column, end: Column) -> Column:
    """Minutes from start to end on a clock; none is null."""
    return F.nullif(F.pmod(end - start, F.lit(1440)), F.lit(0))


def json_links(df: DataFrame, payload: str, path: str, template: str) -> DataFrame:
    """Values at a dotted path of a JSON list, put into a link template; each link of a source once."""
    v = F.explode(F.expr(f"variant_get(try_parse_json({payload}), '$', 'array<variant>')"))
    rows = df.select("source", v.alias("_v")).select("source", F.expr(f"try_variant_get(_v, '$.{path}', 'string')").alias("value")).where("value is not null")
    return rows.select("source", F.replace(F.lit(template), F.lit("{}"), F.col("value")).alias("url")).distinct()


def embedded_shows(df: DataFrame, html: str, attribute: str, schema: str) -> DataFrame:
    """JSON in an HTML attribute -> a row per showing."""
    quoted = lambda k: F.nullif(F.regexp_extract(html, rf"""\b{attribute}=(?:"([^"]*)"|'([^']*)')""", k), F.lit(""))
    raw = F.coalesce(quoted(1), quoted(2))
    text = F.replace(F.replace(raw, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return df.select(*(c for c in df.columns if c != html), F.explode(F.from_json(text, f"struct<items: array<struct<{schema}>>>")["items"]).alias("_x")).select(*(c for c in df.columns if c != html), "_x.*")


def absolute(href: Column) -> Column:
    """A link of the page ``url`` in full; an empty one is null."""
    path = F.regexp_extract("url", r"^([^?#]*)", 1)
    folder = F.when(path.rlike("^https?://[^/]+$"), F.concat(path, F.lit("/"))).otherwise(F.regexp_extract("url", r"^(https?://[^?#]*/)", 1))
    rest = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), href)).when(href.startswith("?"), F.concat(path, href)).otherwise(F.concat(folder, href))
    return F.when(href != "", F.when(href.rlike("^https?://"), href).otherwise(rest))


def page_links(pages: DataFrame, pattern: str = ".*") -> DataFrame:
    """Links of a page on its own host: (url, link, place), each once, at its first place."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]+)"""), F.lit(1))
    rows = pages.select("url", F.posexplode(hrefs).alias("place", "href"))
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    rows = rows.where(~F.col("href").rlike(r"(?i)^(mailto|tel|javascript|data):")).withColumn("link", absolute(F.col("href"))).where((F.regexp_extract("link", r"^(https?://[^/]+)", 1) == host) & F.col("link").rlike(pattern))
    return rows.groupBy("url", "link").agg(F.min("place").alias("place"))


def next_pages(pages: DataFrame) -> DataFrame:
    """Further pages of a listing: rel=next, and numbered pages of the same path."""
    tag = F.regexp_extract("html", r"""(?i)<(?:a|link)\s[^>]*\brel=["']next["'][^>]*>""", 0)
    rel = absolute(F.regexp_extract(tag, r"""(?i)\bhref=["']([^"']+)""", 1))
    numbered = page_links(pages).where((F.split("link", r"\?")[0] == F.split("url", r"\?")[0]) & F.col("link").rlike(r"[?&](page|pagina|p)=\d+")).select("url", "link")
    return pages.select("url", rel.alias("link")).where("link <> ''").union(numbered).distinct()


def sitemap_links(maps: DataFrame, pattern: str = ".*") -> DataFrame:
    """Sitemap documents (url, xml) -> (host, link, lastmod), the newest entry of a link; same host only."""
    entries = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)))
    rows = maps.select("url", entries.alias("e")).select("url", F.trim(F.regexp_extract("e", r"(?s)<loc>\s*(.*?)\s*</loc>", 1)).alias("link"), F.nullif(F.regexp_extract("e", r"<lastmod>(.*?)</lastmod>", 1), F.lit("")).alias("lastmod"))
    host = lambda c: F.regexp_extract(c, r"^https?://(?:www\.)?([^/]+)", 1)
    return rows.where((host("link") == host("url")) & F.col("link").rlike(pattern)).groupBy(host("url").alias("host"), "link").agg(F.max("lastmod").alias("lastmod"))


def split_blocks(pages: DataFrame, opening: str) -> DataFrame:
    """A listing page -> a row per block that begins with the pattern ``opening``: (url, place, block)."""
    parts = F.split("html", f"(?={opening})")
    return pages.select("url", F.posexplode(parts).alias("place", "block")).where(F.col("block").rlike(f"^{opening}"))


def offer_price(payload: Column) -> Column:
    """The lowest EUR price in 1..500 of a JSON-LD offers list; 0 only where the event or a wording says free."""
    o = F.from_json(payload, "array<struct<name: string, description: string, price: string, lowPrice: string, priceCurrency: string>>")
    words = lambda x: F.concat_ws(" ", x["name"], x["description"])
    from ..functions.extract import NO_TICKET

    fair = F.filter(o, lambda x: (F.upper(F.coalesce(x["priceCurrency"], F.lit("EUR"))) == "EUR") & ~words(x).rlike(NO_TICKET))
    value = lambda x: F.coalesce(amount(x["lowPrice"]), amount(x["price"]))
    paid = F.filter(F.transform(fair, value), lambda p: (p >= 1) & (p <= 500))
    free = F.exists(fair, lambda x: (value(x) == 0) & words(x).rlike("(?i)gratis|free|vrij"))
    return F.when(F.size(paid) > 0, F.array_min(paid)).when(free, 0.0)


def family_window(df: DataFrame, today: str) -> DataFrame:
    """What each family of sources publishes: films of the next ten days, museums until they end, venues from today."""
    t = F.lit(today).cast("date")
    film = (F.col("date") >= t) & (F.datediff("date", t) < 10)
    museum = F.coalesce("end", "date") >= t
    return df.where(F.when(F.col("family") == "film", film).when(F.col("family") == "museum", museum).otherwise(F.col("date") >= t))


def first_reader(df: DataFrame) -> DataFrame:
    """Of several readers' rows of a page only those of the reader that comes first (``priority``) and found any."""
    best = df.groupBy("url").agg(F.min("priority").alias("priority"))
    return df.join(best, ["url", "priority"], "left_semi")


def iso_fields(column: str) -> list[Column]:
    date, clock = parse_iso(F.col(column))
    return [date.alias("date"), clock.alias("time")]
