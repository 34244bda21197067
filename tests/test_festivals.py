"""Festival dates by text, and the cascade of readers."""

import datetime as dt

from pyspark.sql import functions as F

from evenloom.operators import festivals as S
from evenloom.operators import readers as R

CASES = [
    ("12, 13 & 14 juni 2027", None, "2027-06-12", "2027-06-14"), ("5 t/m 7 juni", None, "2026-06-05", "2026-06-07"), ("24-26 juli 2026", None, "2026-07-24", "2026-07-26"), ("vr 3 - zo 5 juli", None, "2026-07-03", "2026-07-05"), ("18 • 19 • 20 juni 2027", None, "2027-06-18", "2027-06-20"),
    ("20 + 21 + 22 augustus 2027", None, "2027-08-20", "2027-08-22"), ("8.9.10.11 juli", None, "2026-07-08", "2026-07-11"), ("6 | 7 | 8 mei", None, "2026-05-06", "2026-05-08"), ("30 mei - 1 juni 2027", None, "2027-05-30", "2027-06-01"), ("Fri 27 Aug till Mon 30 Aug", None, "2026-08-27", "2026-08-30"),
    ("tussen 24 sept en 1 okt 2027", None, "2027-09-24", "2027-10-01"), ("June 24 - 27", None, "2026-06-24", "2026-06-27"), ("April 15-18, 2027", None, "2027-04-15", "2027-04-18"), ("June 24-25-26", None, "2026-06-24", "2026-06-26"), ("August 14 2027", None, "2027-08-14", "2027-08-14"), ("June 30th to July 2nd", None, "2026-06-30", "2026-07-02"),
    ("26.11.2026 t/m 17.01.2027", None, "2026-11-26", "2027-01-17"), ("14.08.2027", None, "2027-08-14", "2027-08-14"), ("tickets on sale until June 2nd", None, None, None), ("t/m 5 mei bestellen", None, None, None), ("Noorderzon 2025 vindt plaats van 20 - 30 augustus", None, None, None),
    ("5 jan", None, "2026-01-05", "2026-01-05"), ("2 jan was het feest", None, None, None), ("1 januari. Tot in 2027!", None, "2027-01-01", "2027-01-01"), ("10 januari 2026", None, None, None), ("3 mei 2028", None, None, None), ("31 juni 2026", None, None, None), ("1 februari - 1 mei 2026", None, "2026-02-01", "2026-02-01"),
    ("5 oktober 2026", 6, None, None), ("5 oktober 2026 en 19-21 juni 2026", 6, "2026-06-19", "2026-06-21"), ("4 - 5 oktober 2026", 6, "2026-10-04", "2026-10-05"), ("5 december 2026", 1, "2026-12-05", "2026-12-05"), ("", None, None, None), ("geen datum", 5, None, None), ("29 februari 2027", None, None, None), ("zie 12 mei '27 of 3 juni 2026", None, "2027-05-12", "2027-05-12"),
]


def test_periods_of_texts(spark):
    df = spark.createDataFrame([(k, t, m) for k, (t, m, _, _) in enumerate(CASES)], "k int, text string, month int")
    # the first week of the year, so that dates of a few days ago are no next year's
    got = {r.k: r.p for r in df.select("k", S.text_period(F.col("text"), F.col("month"), F.lit("2026-01-10").cast("date")).alias("p")).collect()}
    wrong = []
    for k, (text, _, a, b) in enumerate(CASES):
        want = None if a is None or b < "2026-01-10" else (a, b)
        found = got[k] and (str(got[k].start), str(got[k].end))
        if found != want:
            wrong.append((text, found, want))
    assert wrong == []


def test_sources_patterns(spark):
    rows = [("a", 'x "d":"2026-05-01"\n"e":"2026-05-03"', r'"d":"([^"]*)".*"e":"([^"]*)"'), ("b", 'x "d":"2026-05-01"', r'"d":"([^"]*)"'), ("c", "(2025-05-01)", r"\((\d{4}-\d\d-\d\d)\)"), ("d", "(2026-02-31)", r"[(](\d{4}-\d\d-\d\d)(?:x)?"), ("e", "x", r"(y)"), ("f", "2026-03-03", None)]
    df = spark.createDataFrame(rows, "k string, html string, p string").select("k", S.pattern_period(F.col("html"), F.col("p"), F.lit("2026-01-10").cast("date")).alias("p"))
    day = dt.date.fromisoformat
    assert {r.k: r.p and tuple(r.p) for r in df.collect()} == {"a": (day("2026-05-01"), day("2026-05-03")), "b": (day("2026-05-01"),) * 2, "c": None, "d": None, "e": None, "f": None}


def test_costly_readers_see_only_what_is_left(spark):
    seen = {}

    def reader(name, takes):
        def read(pages):
            seen[name] = sorted(r.url for r in pages.collect())
            return pages.where(takes).select("url", F.lit(name).alias("title"), F.lit("2026-01-01").cast("date").alias("date"))

        return read

    pages = spark.createDataFrame([("a", "one"), ("b", "two stop"), ("c", "three"), ("d", "four stop"), ("e", None)], "url string, html string")
    out = R.cascade(pages, [("cheap", reader("cheap", "html like 'one%'"), None), ("middle", reader("middle", "html like 'two%'"), "html like '%stop'"), ("costly", reader("costly", "html like '%e%'"), None)])
    assert sorted((r.reader, r.url) for r in out.collect()) == [("cheap", "a"), ("costly", "c"), ("middle", "b")]
    assert seen == {"cheap": ["a", "b", "c", "d", "e"], "middle": ["b", "c", "d", "e"], "costly": ["c", "e"]}
