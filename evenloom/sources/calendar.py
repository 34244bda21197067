"""Calendar documents, share texts and links as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in ((";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def stamp(date: Column, minutes: Column) -> Column:
    day = F.date_add(date, F.floor(minutes / 1440).cast("int"))
    m = F.pmod(minutes, F.lit(1440))
    return F.concat(F.date_format(day, "yyyyMMdd'T'"), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit("00"))


def calendar_events(df: DataFrame, last: Column | None = None) -> DataFrame:
    """(id, vevent) of timed events: an alarm goes off the drive plus half an hour before."""
    end = F.coalesce(last, F.col("time") + 120) if last is not None else F.col("time") + 120
    alarm = F.coalesce(F.col("car"), F.lit(30)) + 30
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "id"), F.concat(F.lit("DTSTART;TZID=Europe/Amsterdam:"), stamp(F.col("date"), F.col("time"))), F.concat(F.lit("DTEND;TZID=Europe/Amsterdam:"), stamp(F.col("date"), end)),
        F.concat(F.lit("SUMMARY:"), escape(F.col("title"))), F.concat(F.lit("LOCATION:"), escape(F.concat_ws(", ", "venue", "city"))), F.concat(F.lit("URL:"), "url"),
        F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"), F.concat(F.lit("TRIGGER:-PT"), alarm.cast("string"), F.lit("M")), F.lit("END:VALARM"), F.lit("END:VEVENT"),
    )
    return df.where(F.col("time").isNotNull()).select("id", lines.alias("vevent"))


def calendar_documents(events: DataFrame, owner: str) -> DataFrame:
    """(owner, document): a calendar for each owner from rows (owner, ord, vevent); a person's plans are few."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "vevent"))), lambda x: x["vevent"]), "\r\n")
    return events.groupBy(owner).agg(F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("PRODID:-//agenda//NL"), body, F.lit("END:VCALENDAR")).alias("document"))


def share_text(date: Column, clock: Column) -> Column:
    return F.concat(F.col("title"), F.lit(" – "), F.concat_ws(", ", "venue", "city"), F.lit(", "), date, F.coalesce(F.concat(F.lit(" om "), clock), F.lit("")), F.coalesce(F.concat(F.lit("\n"), "url"), F.lit("")))


def map_link() -> Column:
    return F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), F.url_encode(F.concat_ws(", ", "venue", "city")))
