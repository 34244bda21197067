"""Reading event pages by a cascade of readers: costly ones see only the pages that cheaper ones left.

Each reader's rows are stored before the next one starts, and the pages that it settled leave the frontier by an anti
join, so every page is read by as few readers as it needs and each of them once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import durable
from .documents import event_from_jsonld, event_from_page, jsonld_events
from .payload import embedded_shows

FIELDS = ("title", "date", "end", "time", "price", "status")
_TYPES = {"title": "string", "date": "date", "end": "date", "time": "string", "price": "double", "status": "string"}
#: (name, pages -> events by url, condition on a page that ends the cascade for it even if nothing is found, or None).
Reader = tuple[str, Callable[[DataFrame], DataFrame], str | None]


def _fields(events: DataFrame) -> DataFrame:
    return events.select("url", *((F.col(c) if c in events.columns else F.lit(None)).cast(_TYPES[c]).alias(c) for c in FIELDS))


def cascade(pages: DataFrame, readers: Sequence[Reader]) -> DataFrame:
    """pages(url, html), a page an address -> (reader, url, title, date, end, time, price, status).

    Rows of a page come from the first reader that finds any. The frontier is stored after each reader but the last; the
    html itself isn't: it is read again for the pages that are left, by their address.
    """
    left, out = pages, None
    for k, (name, read, final) in enumerate(readers):
        found = durable(_fields(read(left)).select(F.lit(name).alias("reader"), "url", *FIELDS))
        out = found if out is None else out.unionByName(found)
        if k + 1 < len(readers):
            left = left.join(found.select("url").distinct(), "url", "left_anti")
            left = left.where(f"not coalesce({final}, false)") if final else left
    return out


#: Pages with such a block list their showings there: an empty list means that they are over.
SHOWS = r"(?i)<component\b[^>]*\bis=[\"']shows[\"']"


def shows_reader(pages: DataFrame) -> DataFrame:
    """Showings of an embedded list, with the page's heading as their title."""
    title = F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>\s*([^<]+?)\s*</h1>", 1))
    rows = pages.where(F.col("html").rlike(SHOWS)).select("url", title.alias("title"), "html")
    shown = embedded_shows(rows, "html", "model", "information: struct<date: string, time: string, price: string>, link: struct<name: string>")
    date = F.coalesce(F.try_to_date("information.date", "yyyy-MM-dd"), F.try_to_date("information.date", "d-M-yyyy"))
    price = F.regexp_extract(F.replace("information.price", F.lit(","), F.lit(".")), r"(\d+(?:\.\d{1,2})?)", 1).try_cast("double")
    clock = F.regexp_extract("information.time", r"\b([01]?\d|2[0-3])[:.]([0-5]\d)\b", 0)
    time = F.when(clock != "", F.lpad(F.replace(clock, F.lit("."), F.lit(":")), 5, "0"))
    return shown.select("url", "title", date.alias("date"), time.alias("time"), price.alias("price"), F.when(F.col("link.name").rlike("(?i)wachtlijst|uitverkocht"), "sold").alias("status")).where("date is not null")


def page_readers(today: str) -> list[Reader]:
    """Structured data, then embedded lists of showings, then the page's text."""
    return [
        ("jsonld", lambda p: event_from_jsonld(jsonld_events(p.where(F.col("html").contains("ld+json")))), None),
        ("shows", shows_reader, f"html rlike '{SHOWS.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'"),
        ("text", lambda p: event_from_page(p, today), None),
    ]


def read_pages(pages: DataFrame, today: str) -> DataFrame:
    return cascade(pages, page_readers(today))
