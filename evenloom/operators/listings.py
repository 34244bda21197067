"""Listings, festivals and tagged payloads: rows from link labels, cards and nested values."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import _NAMES, _date, month_number
from .batches import few_at_once, packed_rows, slim_batches
from .resolve import containing
from ..functions.keys import slug

#: Kinds of listed events by their part of the address, and the form of their labels.
KINDS = {"concert": "p", "cabaret/voorstelling": "c", "festival": "f"}
LABEL = rf"(?is),\s*(?:maandag|dinsdag|woensdag|donderdag|vrijdag|zaterdag|zondag)\s+(\d{{1,2}})\s+({_NAMES})\s+(\d{{4}})(?:\s+om\s+([01]\d|2[0-3]):([0-5]\d))?,\s*(.*)$"


def listing_labels(links: DataFrame) -> DataFrame:
    """links(place, href, title, label) -> typed events, the first of each id.

    The title says kind, name and venue, the label date, time, venue and city.
    """
    path = F.regexp_extract("href", r"/(concert|cabaret/voorstelling|festival)/(\d+)/", 1)
    number = F.regexp_extract("href", r"/(concert|cabaret/voorstelling|festival)/(\d+)/", 2)
    t = r"(?s)^(Concert|Event|Cabaret|Festival)\s+(.*)\s+in\s+(.+)$"
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), path)
    g = lambda k: F.regexp_extract("label", LABEL, k)
    rows = links.where((path != "") & F.col("title").rlike(t) & F.col("label").rlike(LABEL))
    rows = rows.select("place", "href", F.concat(kind, number).alias("id"), _date(g(3).cast("int"), month_number(g(2)), g(1).cast("int")).alias("date"), F.when(g(4) != "", F.concat_ws(":", g(4), g(5))).alias("time"), F.trim(F.regexp_replace(F.regexp_extract("title", t, 2), "(Event|Cabaret|Festival)$", "")).alias("title"), F.trim(F.regexp_extract("title", t, 3)).alias("venue"), F.regexp_extract("title", t, 1).alias("kind"), F.trim(g(6)).alias("_rest"))
    own = F.startswith("_rest", F.col("venue"))
    rest = F.when(own, F.regexp_replace(F.substring(F.col("_rest"), F.length("venue") + 1, F.lit(1000)), "^[, ]+", "")).otherwise(F.trim(F.regexp_replace("_rest", "^[^,]*,", "")))
    rows = rows.where("date is not null").withColumns({"city": F.nullif(F.trim(F.split(rest, ",")[0]), F.lit("")), "status": F.when(F.lower(rest).contains("uitverkocht"), "sold")})
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where("_r = 1").drop("_r", "_rest", "place")


def pick_by_address(heading: Column, structured: Column, url: Column) -> Column:
    """Heading or structured name: the heading if 80 % of its words stand in the address and under half of the name's do."""
    words = lambda c: F.filter(F.split(slug(c), "-"), lambda w: F.length(w) >= 2)
    page = F.split(slug(F.element_at(F.split(F.regexp_replace(F.split(url, r"\?")[0], "/+$", ""), "/"), -1)), "-")
    share = lambda c: F.size(F.array_intersect(words(c), page)) / F.greatest(F.size(F.array_distinct(words(c))), F.lit(1))
    return F.coalesce(F.when(heading.isNotNull() & structured.isNotNull() & (share(heading) >= 0.8) & (share(structured) < 0.5), heading), structured, heading)


def skip_words(df: DataFrame, words: list[str]) -> DataFrame:
    """Without titles that contain any of the words (services, office hours), whatever their case."""
    import re

    return df.where(~F.coalesce(F.col("title").rlike("(?i)" + "|".join(map(re.escape, words))), F.lit(False))) if words else df


def exhibition_title(title: Column) -> Column:
    """Without a period in front or between bars; spaced-out letters are joined."""
    t = F.regexp_replace(title, r"^\s*\d{1,2}[./]\d{1,2}(?:[./]20\d{2})?\s*[-–—]\s*\d{1,2}[./]\d{1,2}[./]20\d{2}\s*[|:-]?\s*", "")
    t = F.regexp_replace(t, rf"(?i)^[^|]*\b\d{{1,2}}\s+(?:{_NAMES})[^|]*\|\s*", "")
    t = F.when(t.rlike(r"^(?:\S ){3,}\S$"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)
    return F.when(F.length(F.trim(t)) > 0, F.trim(t)).otherwise(title)


def ongoing(df: DataFrame, today: str) -> DataFrame:
    """Exhibitions with only an end have begun: they start today and are marked."""
    t = F.lit(today).cast("date")
    open_ = F.col("start").isNull() & F.col("end").isNotNull()
    return df.withColumns({"ongoing": open_, "date": F.when(open_, F.least(t, F.col("end"))).otherwise(F.col("start"))})


def festival_periods(events: DataFrame, periods: DataFrame, today: str) -> DataFrame:
    """One row a festival: (source, start, end) from its structured events, else from its text's period.

    events(source, date, end, month) are structured dates, periods(source, start, end, month) what texts give (see
    documents.with_period); month is the usual one or null. Past ones go; a single day of events more than a month off
    the usual one goes; a text's period must be under 75 days, not just today, and not beyond next year.
    """
    t = F.lit(today).cast("date")
    off = lambda d: F.least(F.pmod(F.month(d) - F.col("month"), F.lit(12)), F.pmod(F.col("month") - F.month(d), F.lit(12)))
    told = events.where((F.coalesce("end", "date") >= t) & (F.col("end").isNotNull() | F.col("month").isNull() | (off("date") <= 1)))
    told = told.groupBy("source").agg(F.min("date").alias("start"), F.max(F.coalesce("end", "date")).alias("end"))
    a, b = F.col("start"), F.coalesce("end", "start")
    single = a == b
    fair = (a <= b) & (F.datediff(b, a) < 75) & (b >= t) & (F.year(a) <= F.year(t) + 1) & ~(single & (a == t)) & ~(single & F.col("month").isNotNull() & (off("start") > 1))
    read = periods.where(fair).groupBy("source").agg(F.min_by(F.struct("start", b.alias("end")), F.col("start")).alias("p")).select("source", "p.start", "p.end")
    return told.unionByName(read.join(told.select("source"), "source", "left_anti"))


def untagged(df: DataFrame, payload: str, having: str) -> DataFrame:
    """(source, place, object): every object with the key ``having`` in tagged JSON, where a value is written [type, value].

    Tagged values nest to any depth, so a small walker runs over Arrow batches.
    """

    def plain(v: object) -> object:
        if isinstance(v, list) and len(v) == 2 and isinstance(v[0], int) and not isinstance(v[0], bool):
            return [plain(x) for x in v[1]] if v[0] == 1 and isinstance(v[1], list) else plain(v[1]) if isinstance(v[1], dict) else v[1]
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    def found(v: object) -> Iterator[dict]:
        todo = [v]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                if isinstance(x.get(having), list):
                    yield x
                todo.extend(reversed(list(x.values())))
            elif isinstance(x, list):
                todo.extend(reversed(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_at_once(batches):
            out = []
            for source, text in zip(part["source"].to_pylist(), part["payload"].to_pylist()):
                try:
                    out += [(source, k, json.dumps(x)) for k, x in enumerate(found(plain(json.loads(text or "null"))))]
                except (ValueError, RecursionError):  # nested beyond what can be read: as bad as any other
                    continue
            yield from packed_rows(out, ["source", "place", "object"], kinds)

    kinds = pa.schema([("source", pa.string()), ("place", pa.int32()), ("object", pa.string())])
    return slim_batches(df.select(F.col("source").cast("string").alias("source"), F.col(payload).alias("payload"))).mapInArrow(run, "source string, place int, object string")


def date_lists(df: DataFrame, dates: str) -> DataFrame:
    """Exhibitions given as an array of ISO dates: first and last."""
    d = F.transform(dates, lambda x: F.try_to_date(F.left(x, F.lit(10)), "yyyy-MM-dd"))
    return df.withColumns({"start": F.array_min(d), "end": F.array_max(d)})


def cards(pages: DataFrame, opening: str, fields: dict[str, str], epoch: str | None = None) -> DataFrame:
    """HTML cards -> rows: each field is the first group of its pattern in the card; ``epoch`` names a field in seconds since 1970."""
    block = F.explode(F.split("html", f"(?={opening})"))
    rows = pages.select("url", block.alias("_b")).where(F.col("_b").rlike(f"^{opening}"))
    rows = rows.select("url", *(F.nullif(F.regexp_extract("_b", p, 1), F.lit("")).alias(n) for n, p in fields.items()))
    if epoch:
        rows = rows.withColumn(epoch, F.from_utc_timestamp(F.timestamp_seconds(F.col(epoch).cast("bigint")), "Europe/Amsterdam"))
    return rows.dropDuplicates()


def twelve_hour(text: Column) -> Column:
    """"8:30 pm" as HH:MM."""
    p = r"(?i)(\d{1,2})(?::(\d\d))?\s*([ap])\.?m\b"
    h = F.regexp_extract(text, p, 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(text, p, 3)) == "p", 12).otherwise(0)
    return F.when(text.rlike(p), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.coalesce(F.nullif(F.regexp_extract(text, p, 2), F.lit("")), F.lit("00"))))


def alarm_hits(events: DataFrame, words: DataFrame) -> DataFrame:
    """(id, word): the first of a user's words(word, place) that occurs in title, venue or city."""
    hay = F.lower(F.concat_ws(" ", "title", "venue", "city"))
    hits = containing(events.select("id", hay.alias("hay")), "hay", words.select(F.lower("word").alias("w"), "word", "place"), "w")
    return hits.groupBy("id").agg(F.min_by("word", "place").alias("word"))


def count_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source, n, was, delta) of two reports' item counts."""
    out = now.select("source", "n").join(before.select("source", F.col("n").alias("was")), "source", "left")
    return out.withColumn("delta", F.col("n") - F.coalesce("was", F.lit(0)))

