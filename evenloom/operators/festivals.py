"""When a festival is: from its structured events, from a pattern of its source, or from its site's text.

The text is read by four grammars. Each gives all its matches with their places in one scan (the text is split at the
matches, the pieces' lengths add up to places), every match becomes a period or nothing, and what stands before a match
decides on it: words of deadlines, a year shortly before. Of the periods that hold the first in the text counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import _date
from ..functions.keys import unescape
from ..functions.urls import let
from .documents import once
from .web import attribute, tags

#: The first letters of months, the ways in which days are joined, and the four forms of dates.
MONTHS = {"jan": 1, "feb": 2, "mrt": 3, "maa": 3, "mar": 3, "apr": 4, "mei": 5, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "dec": 12}
_MONTH = rf"({'|'.join(MONTHS)})[a-z]*\.?"
_WORD = r"(?:[a-z]{2,9}\.?\s+)?"
#: "12, 13 & 14 juni 2027", "5 t/m 7 juni", "vr 3 - zo 5 juli", "8.9.10.11 juli"
DAYS_MONTH = rf"(?i)\b(\d{{1,2}})(?:\s*(?:[-–—/&,+•·.|]|t/m|tot en met|en|and)\s*{_WORD}(\d{{1,2}}))*\s+{_MONTH}(?:\s+'?(\d{{4}}|\d{{2}}))?\b"
#: "30 mei - 1 juni 2027", "Fri 27 Aug till Mon 30 Aug"
TWO_MONTHS = rf"(?i)\b(\d{{1,2}})\s+{_MONTH}(?:\s+(\d{{4}}))?\s*(?:[-–—]|t/m|tot en met|tot|till|until|en|and)\s*{_WORD}(\d{{1,2}})\s+{_MONTH}(?:\s+(\d{{4}}))?"
#: "June 24 - 27", "April 15-18, 2027", "June 24-25-26"
MONTH_DAYS = rf"(?i)\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*(?:[-–—&/]|t/m|to|till|until)\s*(?:{_MONTH}\s+)?(\d{{1,2}})(?:st|nd|rd|th)?)*(?:,?\s+(\d{{4}}))?(?![\d:])"
#: "26.11.2026 t/m 17.01.2027", "14.08.2027"
NUMBERS = r"(?i)\b(\d{1,2})[./-](\d{1,2})[./-](20\d{2})(?:\s*(?:[-–—]|t/m|tot en met|tot)\s*(\d{1,2})[./-](\d{1,2})[./-](20\d{2}))?"
DEADLINE = r"(?i)(until|till|tot|t/m|before|voor|deadline|uiterlijk)\s*$"
#: Days that a period may last, and how much of a page is read.
LONGEST, TEXT = 75, 8000


def month_of(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    return F.try_element_at(table, F.lower(F.left(name, F.lit(3))))


def site_text(html: Column) -> Column:
    """What is read of a site: its descriptions, then the start of its text, without scripts and styles."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript)\b.*?</\1\s*>", " ")
    text = F.trim(F.regexp_replace(unescape(F.regexp_replace(plain, r"<[^>]+>", " ")), r"(?U)\s+", " "))
    meta = lambda key, value: F.try_element_at(F.transform(F.filter(tags(html, "meta"), lambda t: F.lower(attribute(t, key)) == value), lambda t: attribute(t, "content")), F.lit(1))
    return F.concat_ws(" ", F.nullif(meta("name", "description"), F.lit("")), F.nullif(meta("property", "og:description"), F.lit("")), F.left(text, F.lit(TEXT)))


def matches(text: Column, pattern: str) -> Column:
    """All matches as an array of (at, match), at counting from 0."""

    def placed(pieces: Column, found: Column) -> Column:
        lengths = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(found, F.length).alias("own"))
        step = lambda acc, x: F.struct((acc["end"] + x["gap"] + x["own"]).alias("end"), F.concat(acc["at"], F.array(acc["end"] + x["gap"])).alias("at"))
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
        places = F.aggregate(F.slice(lengths, 1, F.size(found)), start, step)["at"]
        return F.arrays_zip(places.alias("at"), found.alias("match"))

    return let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f")), lambda x: placed(x["p"], x["f"]))


def _before(text: Column, at: Column, most: int) -> Column:
    """Up to ``most`` characters that stand before a place."""
    first = F.greatest(at - most, F.lit(0))
    return F.substring(text, first + 1, at - first)


def _day(text: Column, at: Column, day: Column, month: Column, year: Column, today: Column) -> Column:
    """A day of a match. Without a year the one named shortly before it counts, or this one; a day that has gone by is next
    year's only where the text names that year."""
    d, m = day.try_cast("int"), month_of(month)
    hints = F.regexp_extract_all(_before(text, at, 40), F.lit(r"\b(20\d{2})\b"), F.lit(1))
    hint = F.try_element_at(hints, F.lit(-1)).try_cast("int")
    own = F.when(F.length(year) == 2, 2000 + year.try_cast("int")).otherwise(year.try_cast("int"))
    this = _date(F.year(today), m, d)
    named = F.regexp_like(text, F.concat(F.lit(r"\b"), (F.year(today) + 1).cast("string"), F.lit(r"\b")))
    inferred = F.when((F.datediff(today, this) > 7) & named, _date(F.year(today) + 1, m, d)).otherwise(this)
    return F.when(year != "", _date(own, m, d)).when(hint.isNotNull(), _date(hint, m, d)).otherwise(inferred)


def text_period(text: Column, month: Column, today: Column) -> Column:
    """The first period that holds in a text as (start, end), null without one; ``month`` is the usual one, or null.

    A single day isn't one if a deadline's words stand before it, if it is today, or if it is over a month off the usual
    one. A period is under LONGEST days long, isn't over, and begins next year at the latest.
    """

    def periods(pattern: str, rank: int, ends: Callable[[Callable[[int], Column], Column], tuple[Column, Column]]) -> Column:
        def read(x: Column) -> Column:
            a, b = ends(lambda k: x[f"g{k}"], x["at"])
            return F.struct(x["at"].alias("at"), F.lit(rank).alias("rank"), a.alias("start"), b.alias("end"))

        groups = re.compile(pattern).groups
        cut = lambda x: F.struct(x["at"].alias("at"), *(F.regexp_extract(x["match"], pattern, k).alias(f"g{k}") for k in range(1, groups + 1)))
        return F.transform(F.transform(matches(text, pattern), cut), read)

    day = lambda at, d, m, y: _day(text, at, d, m, y, today)
    either = lambda a, b: F.when(a != "", a).otherwise(b)
    number = lambda g, k: _date(g(k + 2).try_cast("int"), g(k + 1).try_cast("int"), g(k).try_cast("int"))
    found = F.concat(
        periods(TWO_MONTHS, 0, lambda g, at: (day(at, g(1), g(2), either(g(3), g(6))), day(at, g(4), g(5), g(6)))),
        periods(DAYS_MONTH, 1, lambda g, at: (day(at, g(1), g(3), g(4)), day(at, either(g(2), g(1)), g(3), g(4)))),
        periods(MONTH_DAYS, 2, lambda g, at: (day(at, g(2), g(1), g(5)), day(at, either(g(4), g(2)), F.when(g(4) != "", either(g(3), g(1))).otherwise(g(1)), g(5)))),
        periods(NUMBERS, 3, lambda g, at: (number(g, 1), F.when(g(4) != "", number(g, 4)).otherwise(number(g, 1)))),
    )

    def holds(p: Column) -> Column:
        a, b = p["start"], p["end"]
        off = F.least(F.pmod(F.month(a) - month, F.lit(12)), F.pmod(month - F.month(a), F.lit(12)))
        single = (a == b) & (_before(text, p["at"], 12).rlike(DEADLINE) | (a == today) | F.coalesce(off > 1, F.lit(False)))
        return F.coalesce((a <= b) & (F.datediff(b, a) < LONGEST) & (b >= today) & (F.year(a) <= F.year(today) + 1) & ~single, F.lit(False))

    return let(F.array_min(F.filter(found, holds)), lambda p: F.when(p.isNotNull(), F.struct(p["start"].alias("start"), p["end"].alias("end"))))


def pattern_period(html: Column, pattern: Column, today: Column) -> Column:
    """The period that a source's own pattern finds in the page's source, scripts included: group 1 its start and group 2,
    where there is one, its end, both yyyy-MM-dd; null if it is over."""
    bare = F.regexp_replace(pattern, r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?(?!<[A-Za-z])", "")
    several = F.length(bare) - F.length(F.replace(bare, F.lit("("), F.lit(""))) > 1
    full = F.concat(F.lit("(?s)"), pattern)
    iso = lambda c: F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(c, "yyyy-MM-dd"))
    start = iso(F.call_function("regexp_extract", html, full, F.lit(1)))
    end = F.coalesce(F.when(several, iso(F.call_function("regexp_extract", html, full, F.lit(2)))), start)
    found = F.struct(start.alias("start"), end.alias("end"))
    return F.when(pattern.isNotNull(), let(found, lambda p: F.when((p["end"] >= today) & (p["start"] <= p["end"]), p)))


def festival_periods(sites: DataFrame, events: DataFrame, today: str) -> DataFrame:
    """sites(source, html, month, date_regex), events(source, date, end) -> (source, start, end): one row for each festival found.

    Structured events come first: those that aren't over, single days over a month off the usual one aside. Pages are read
    only where they give nothing: by the source's pattern, then by the text's grammars. ``end`` is null for a single day.
    """
    t = F.lit(today).cast("date")
    off = F.least(F.pmod(F.month("date") - F.col("month"), F.lit(12)), F.pmod(F.col("month") - F.month("date"), F.lit(12)))
    told = events.join(sites.select("source", "month"), "source").where((F.coalesce("end", "date") >= t) & (F.col("end").isNotNull() | F.coalesce(off <= 1, F.lit(True))))
    told = told.groupBy("source").agg(F.min("date").alias("start"), F.max(F.coalesce("end", "date")).alias("end"))
    rest = sites.join(told.select("source"), "source", "left_anti")
    rest = rest.select("source", "month", "html", once(pattern_period(F.col("html"), F.col("date_regex"), t)).alias("own"))
    text = F.when(F.col("own").isNull(), site_text(F.coalesce("html", F.lit(""))))
    rest = rest.select("source", "month", "own", once(text).alias("text"))
    rest = rest.select("source", once(F.coalesce("own", F.when(F.col("text").isNotNull(), text_period(F.col("text"), F.col("month"), t)))).alias("p")).where("p is not null").select("source", "p.start", "p.end")
    return told.unionByName(rest).select("source", "start", F.when(F.col("end") > F.col("start"), F.col("end")).alias("end"))
