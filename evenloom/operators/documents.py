"""Events from pages: periods, structured data, timetables, titles, listings with details, search names."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import _NAMES, _date, groups, infer_year, month_number, price_from_text, sale_status, until_date, with_date
from ..functions.keys import acts, artist_key, bare_key
from ..functions.urls import let
from .batches import few_at_once, packed_rows, slim_batches

_T = rf"(\d{{1,2}})\s+({_NAMES})\b\.?(?:\s+'?(\d{{4}}))?"
_N = r"(\d{1,2})[./-](\d{1,2})[./-](20\d\d)"
#: Wordings between and before the dates of a period.
_BARS = r"\s*(?:\|\s*)*"
_TO = rf"{_BARS}(?:t/m|t\.m\.|tot en met|tot|until|till|to|through|[-–—]|\|){_BARS}(?:[a-z]{{2,9}}\.?\s+)?"
_GAP = rf"{_BARS}(?:(?:tot en met|t/m|tot|until){_BARS})?"
_UNTIL = rf"(?i)\b(?:t/m|t\.m\.|tot en met|nog tot|te zien tot|tot|until|through){_BARS}(?:[a-z]{{2,9}}\.?\s+)?(?:{_T}|{_N})"
_FROM = rf"(?i)\b(?:te zien vanaf|vanaf|from|opening|opent|start){_BARS}(?:[a-z]{{2,9}}\.?\s+)?(?:{_T}|{_N})"


def with_period(df: DataFrame, text: str, today: Column) -> DataFrame:
    """Add start and end of the first exhibition period of a text column; an open start or end is null, as are both of none.

    Two dates, also with no more than space or bars between them, a day and a date, numeric and short numeric dates, "until" (with the year of a full date shortly
    before it) and "from" (with an end within the next 600 characters); the one that stands first counts. In steps,
    so that no pattern is matched twice.
    """
    patterns = {"tt": (rf"(?i){_T}(?:{_TO}|{_GAP}){_T}", 6), "dt": (rf"(?i)(?<![\d./-])(\d{{1,2}}){_TO}{_T}", 4), "nn": (rf"(?i){_N}(?:{_TO}|{_GAP}){_N}", 6), "n2": (rf"\b(\d{{1,2}})[./](\d{{1,2}})\s*[-–—]\s*{_N}", 5), "un": (_UNTIL, 6), "fr": (_FROM, 6)}
    df = df.withColumn("_today", today).withColumns({f"_{k}": groups(F.col(text), p, n) for k, (p, n) in patterns.items()})
    c = lambda k: F.col(f"_{k}")
    i = lambda k: c(k).cast("int")
    before = F.substring(F.col(text), F.greatest(F.lit(1), c("un.at") - 400), F.least(F.lit(400), c("un.at") - 1))
    after = F.substring(F.col(text), c("fr.at") + 1, F.lit(600))
    full = rf"(?is).*(?<!\d)(\d{{1,2}})\s+({_NAMES})\b\.?\s+'?(\d{{4}})"
    df = df.withColumns({"_be": groups(F.when(c("un.at") > 0, before), full, 3), "_af": groups(F.when(c("fr.at") > 0, after), _UNTIL, 6)})
    m = {f"_m_{k}_{g}": month_number(c(f"{k}.g{g}")) for k, g in (("tt", 2), ("tt", 5), ("dt", 3), ("un", 2), ("fr", 2), ("be", 2), ("af", 2))}
    df = df.withColumns(m)
    named = lambda k, y, mo, d: F.when(i(f"{k}.g{y}").isNotNull(), _date(i(f"{k}.g{y}"), F.col(f"_m_{k}_{mo}"), i(f"{k}.g{d}"))).otherwise(infer_year(F.col(f"_m_{k}_{mo}"), i(f"{k}.g{d}"), F.col("_today")))
    numeric = lambda k, y, mo, d: _date(i(f"{k}.g{y}"), i(f"{k}.g{mo}"), i(f"{k}.g{d}"))
    mixed = lambda k: F.when(i(f"{k}.g1").isNotNull(), named(k, 3, 2, 1)).otherwise(numeric(k, 6, 5, 4))
    df = df.withColumns({"_b1": named("tt", 6, 5, 4), "_b2": named("dt", 4, 3, 2), "_a3": numeric("nn", 3, 2, 1), "_b3": numeric("nn", 6, 5, 4), "_b4": numeric("n2", 5, 4, 3), "_a5": _date(i("be.g3"), F.col("_m_be_2"), i("be.g1")), "_b5": mixed("un"), "_a6": mixed("fr")})
    df = df.withColumns({
        "_a1": _date(F.coalesce(i("tt.g3"), F.year("_b1")), F.col("_m_tt_2"), i("tt.g1")), "_a2": _date(F.year("_b2"), F.month("_b2"), i("dt.g1")), "_a4": _date(F.year("_b4"), i("n2.g2"), i("n2.g1")),
        "_near": _date(F.year("_a5"), F.col("_m_un_2"), i("un.g1")), "_e": F.when(i("af.g1").isNotNull(), _date(F.coalesce(i("af.g3"), F.year("_a6")), F.col("_m_af_2"), i("af.g1"))).otherwise(numeric("af", 6, 5, 4)),
    })
    borrowed = i("un.g1").isNotNull() & i("un.g3").isNull() & F.col("_near").isNotNull()
    df = df.withColumns({
        "_a1": F.when(i("tt.g3").isNull() & (F.col("_a1") > F.col("_b1")), F.add_months("_a1", -12)).otherwise(F.col("_a1")),
        "_b5": F.when(borrowed, F.when(F.col("_near") < F.col("_a5"), F.add_months("_near", 12)).otherwise(F.col("_near"))).otherwise(F.col("_b5")), "_a5": F.when(borrowed, F.col("_a5")),
        "_e": F.when(F.col("_e") > F.col("_a6"), F.col("_e")).when(i("af.g1").isNotNull() & i("af.g3").isNull(), F.add_months("_e", 12)),
    })

    def option(k: str, a: str, b: str, ok: Column, later: float = 0) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), F.struct((c(f"{k}.at") + F.lit(later)).cast("double").alias("at"), F.col(a).alias("a"), F.col(b).alias("b")))

    found = F.array(
        option("tt", "_a1", "_b1", (F.col("_a1") <= F.col("_b1")) & (F.datediff("_b1", "_a1") < 366 * 12)), option("dt", "_a2", "_b2", F.col("_a2") <= F.col("_b2")), option("nn", "_a3", "_b3", F.col("_a3") <= F.col("_b3")), option("n2", "_a4", "_b4", F.col("_a4") <= F.col("_b4")),
        option("un", "_a5", "_b5", F.col("_b5").isNotNull()), option("fr", "_a6", "_e", F.col("_a6").isNotNull(), 0.5),
    )
    df = df.withColumn("_best", F.array_min(F.filter(found, lambda x: x.isNotNull())))
    names = ["_today", "_be", "_af", "_near", "_e", "_best", *(f"_{k}" for k in patterns), *m, *(f"_{x}{n}" for x in "ab" for n in range(1, 7))]
    return df.withColumns({"start": F.col("_best.a"), "end": F.col("_best.b")}).drop(*names)


_BLOCK = re.compile(r"""<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>""", re.I | re.S)


def _events_in(value: object) -> Iterator[dict]:
    """Objects whose type is an event, however deep."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            kinds = x.get("@type")
            if any(isinstance(k, str) and (k.endswith("Event") or k == "Festival") for k in (kinds if isinstance(kinds, list) else [kinds])):
                yield x
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))


def jsonld_events(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, place, event): every event object of the pages' structured data, as JSON text.

    JSON of any depth needs recursion, so a small parser runs over Arrow batches; objects written one after another
    are read as a list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_at_once(batches):
            out = []
            for url, page in zip(part["url"].to_pylist(), part["html"].to_pylist()):
                place = 0
                for block in _BLOCK.findall(page or ""):
                    try:
                        value = json.loads(block)
                    except (ValueError, RecursionError):  # nested beyond what can be read: as bad as any other
                        try:
                            value = json.loads("[" + re.sub(r"\}\s*\{", "},{", block.strip()).rstrip(",") + "]")
                        except (ValueError, RecursionError):
                            continue
                    for event in _events_in(value):
                        out.append((url, place, json.dumps(event)))
                        place += 1
            yield from packed_rows(out, ["url", "place", "event"], kinds)

    rows = pages.select("url", "html")
    kinds = pa.schema([("url", pa.string()), ("place", pa.int32()), ("event", pa.string())])
    return slim_batches(rows).mapInArrow(run, "url string, place int, event string")


def event_from_jsonld(objects: DataFrame) -> DataFrame:
    """(url, event JSON) -> typed events; without a date from 2000 on or a title there is none.

    A night's end and a midnight end belong to the evening; several performers after the first are support.
    """
    from ..functions.extract import parse_iso
    from .payload import offer_price

    j = lambda p: F.get_json_object("event", f"$.{p}")
    name = lambda p: F.coalesce(j(f"{p}.name"), F.when(~F.coalesce(j(p), F.lit("")).rlike(r"^[\[{]"), j(p)))
    date, clock = parse_iso(j("startDate"))
    end, end_clock = parse_iso(j("endDate"))
    days = F.datediff(end, date)
    early = F.coalesce(end_clock < "08:00", F.lit(False))
    midnight = F.coalesce(j("endDate").contains("T00:00"), F.lit(False)) & clock.isNotNull()
    last = F.when((early | midnight) & (days == 1), None).when(early & (days > 1), F.date_sub(end, 1)).otherwise(end)
    work = name("workPresented")
    title = F.trim(F.when(work.isNotNull() & ~work.rlike(r"^[\d\s#-]+$"), work).otherwise(F.coalesce(name("name"), work)))
    listed = F.from_json(j("performer"), "array<struct<name: string>>")
    names = F.filter(F.transform(listed, lambda p: p["name"]), lambda n: n.isNotNull() & (F.lower(n) != F.lower(title)))
    screening = F.coalesce(j("@type").contains("ScreeningEvent"), F.lit(False))
    offers = F.coalesce(F.when(j("offers").startswith("["), j("offers")), F.concat(F.lit("["), j("offers"), F.lit("]")))
    words = F.lower(F.concat_ws(" ", j("eventStatus"), j("offers")))
    status = F.when(words.rlike("soldout|uitverkocht"), "sold").when(j("eventStatus").rlike("(?i)cancel|postponed"), "cancelled")
    free = F.lower(F.coalesce(j("isAccessibleForFree"), F.lit(""))).isin("true", "https://schema.org/true")
    out = objects.select(
        "url", date.alias("date"), clock.alias("time"), F.when(last > date, last).alias("end"), title.alias("title"), F.coalesce(F.when(j("url").startswith("http"), j("url")), F.col("url")).alias("link"), screening.alias("screening"), name("location").alias("loc"),
        F.when((F.size(names) > 1) & ~screening, F.slice(names, 2, 3)).alias("support"), F.when(free, 0.0).otherwise(offer_price(offers)).alias("price"), status.alias("status"),
    )
    return out.where((F.year("date") >= 2000) & (F.length("title") > 0))


#: Labels of a timetable that are no act, rows for a few visitors only, and opening of the doors.
NO_ACT = r"(?i)eind|einde|\bend\b|curfew|sluit|close|pauze|break|aanvang|^start$|begin|kassa|garderobe|soundcheck|merch|^(intro|introductie|inleiding|q ?& ?a|nagesprek|aftertalk|film|filmscreening|screening|workshop|lezing|talk|borrel|programma|pre-?party|after-?party|live-?concert|concert|show|voorprogramma|support|hoofdact|headliner)$"
VIP = r"(?i)\bvip\b|meet ?(&|and|n) ?greet|\bm&g\b|early entry"
DOORS = r"(?i)deur|doors|zaal\s*open|^open$|opening"


def timetable(df: DataFrame, rows: str, title: str) -> DataFrame:
    """Add doors, start, support and times from an array of (time HH:MM, label) rows of an evening.

    The main act is the one whose name and the title's contain each other. A schedule that doesn't ascend (after
    midnight counting on) isn't trusted beyond its doors.
    """
    clean = F.filter(F.transform(rows, lambda r: F.struct(F.lpad(F.replace(r["time"], F.lit("."), F.lit(":")), 5, "0").alias("s"), F.trim(r["label"]).alias("a"))), lambda r: r["s"].rlike(r"^([01]\d|2[0-3]):[0-5]\d$") & (r["a"] != "") & ~r["a"].rlike(VIP))
    listed = F.filter("_rows", lambda r: ~r["a"].rlike(DOORS) & ~r["a"].rlike(NO_ACT) & (F.length(r["a"]) <= 80))
    minute = lambda s: F.left(s, F.lit(2)).cast("int") * 60 + F.right(s, F.lit(2)).cast("int")
    out = df.withColumn("_rows", clean).withColumn("_acts", listed)
    out = out.withColumn("doors", F.get(F.filter("_rows", lambda r: r["a"].rlike(DOORS)), F.lit(0))["s"])
    out = out.withColumn("_mins", F.transform("_acts", lambda r: F.when(minute(r["s"]) < minute(F.col("_acts")[0]["s"]) - 360, minute(r["s"]) + 1440).otherwise(minute(r["s"]))))
    out = out.withColumn("_acts", F.when((F.size("_acts") > 0) & (F.size("_acts") <= 15) & (F.array_sort("_mins") == F.col("_mins")), F.col("_acts")))
    key = bare_key(title)
    main = F.array_position(F.transform("_acts", lambda r: (bare_key(r["a"]) != "") & (key.contains(bare_key(r["a"])) | bare_key(r["a"]).contains(key))), True).cast("int")
    out = out.withColumn("_main", F.when(main > 0, main))
    out = out.withColumns({"times": F.col("_acts"), "start": F.get("_acts", F.col("_main") - 1)["s"], "support": F.when(F.col("_main") > 1, F.transform(F.slice("_acts", 1, F.least(F.col("_main") - 1, F.lit(6))), lambda r: r["a"]))})
    return out.drop("_rows", "_acts", "_mins", "_main")


#: Words that give a timetable's row a role, begin its label, or are all that is left of one without a name.
ROLE = r"(?i)^(?:support(?:[ -]?acts?)?|opener|(?:very\s+)?special\s+guests?|voorprogramma|gast(?:act)?)\b[\s:–-]*"
BEGINS = r"(?i)^(?:aanvang|start|begin)\b[\s:–-]*"
NAMELESS = r"(?i)^(?:de\s+|het\s+)?(?:show|concert|voorstelling|programma|optreden|hoofdact|hoofdprogramma|main\s*act|headliner)?$"


def timetable_roles(df: DataFrame, rows: str, title: str) -> DataFrame:
    """Add doors, tot, start, support and times from an array of (time, label) rows whose labels say who plays what.

    A start without a name is the main act's, named by the title; openers, guests and supports are support acts, and of
    no use without a name. Rows may come in any order; after an evening, times before six count as the next morning.
    Without a main act there are no start and no times.
    """
    bare = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), r"^[ :–-]+|[ :–-]+$", "")
    minute = lambda s: F.left(s, F.lit(2)).cast("int") * 60 + F.right(s, F.lit(2)).cast("int")
    at = lambda r: F.nullif(F.regexp_extract(r["time"], r"\b([01]?\d|2[0-3])[:.]([0-5]\d)", 0), F.lit(""))
    clean = F.filter(F.transform(rows, lambda r: F.struct(F.lpad(F.replace(at(r), F.lit("."), F.lit(":")), 5, "0").alias("s"), bare(r["label"]).alias("a"))), lambda r: r["s"].isNotNull() & (r["a"] != "") & ~r["a"].rlike(VIP))
    out = df.withColumn("_rows", clean)
    ends = r"(?i)eind|\bend\b|curfew"
    first = lambda found: F.get(F.filter("_rows", found), F.lit(0))["s"]
    out = out.withColumns({"tot": first(lambda r: r["a"].rlike(ends)), "doors": first(lambda r: ~r["a"].rlike(ends) & r["a"].rlike(DOORS))})
    rest = lambda r: F.regexp_replace(r["a"], BEGINS, "")
    acts = F.transform(F.filter("_rows", lambda r: ~r["a"].rlike(ends) & ~r["a"].rlike(DOORS)), lambda r: F.struct(r["s"].alias("s"), rest(r).rlike(ROLE).alias("sup"), (rest(r) != r["a"]).alias("begins"), bare(F.regexp_replace(rest(r), ROLE, "")).alias("a")))
    acts = F.filter(acts, lambda x: (x["sup"] | x["begins"]) & ~(x["sup"] & x["a"].rlike(NAMELESS)))
    acts = F.transform(acts, lambda x: F.struct(minute(x["s"]).alias("m"), x["s"].alias("s"), x["sup"].alias("sup"), F.when(x["a"].rlike(NAMELESS), F.col(title)).otherwise(x["a"]).alias("a")))
    out = out.withColumn("_acts", F.filter(acts, lambda x: F.length(x["a"]) <= 80))
    late = F.array_max(F.transform("_acts", lambda x: x["m"])) >= 720
    placed = F.transform("_acts", lambda x, i: F.struct(F.when(late & (x["m"] < 360), x["m"] + 1440).otherwise(x["m"]).alias("m"), i.alias("i"), x["s"].alias("s"), x["sup"].alias("sup"), x["a"].alias("a")))
    out = out.withColumn("_acts", F.array_sort(placed)).withColumn("_main", F.array_position(F.transform("_acts", lambda x: x["sup"]), False).cast("int"))
    main = F.when(F.col("_main") > 0, F.col("_main"))
    support = F.slice(F.transform(F.filter("_acts", lambda x, i: x["sup"] & (main.isNull() | (i < main - 1))), lambda x: x["a"]), 1, 6)
    out = out.withColumns({"support": F.when(F.size(support) > 0, support), "start": F.get("_acts", main - 1)["s"], "times": F.when(main.isNotNull(), F.transform(F.slice("_acts", 1, 12), lambda x: F.struct(x["a"].alias("a"), x["s"].alias("s"))))})
    return out.drop("_rows", "_acts", "_main")


def valid_times(times: Column) -> Column:
    """Act times (a, s HH:MM) as minutes in order; six hours before the first is after midnight."""
    ok = F.filter(times, lambda t: t["s"].rlike(r"^\d{1,2}[:.]\d\d$") & (F.trim(t["a"]) != ""))
    minute = lambda s: F.regexp_extract(s, r"^(\d{1,2})", 1).cast("int") * 60 + F.right(s, F.lit(2)).cast("int")
    shifted = F.transform(ok, lambda t: F.struct(F.when(minute(t["s"]) < minute(ok[0]["s"]) - 360, minute(t["s"]) + 1440).otherwise(minute(t["s"])).alias("s"), F.trim(t["a"]).alias("a")))
    return F.array_sort(shifted)


def clean_titles(df: DataFrame) -> DataFrame:
    """Per-source title clean-up of rows (source, url, title, date, end, vtype): the part that names the show.

    A date in the title is the show's date if its page has no other event; the source's own name, what the source's
    ``title_strip`` (a pattern, where the rows have one) matches, dates in front and times behind go; too short a remainder
    changes nothing.
    """
    from ..functions.extract import date_in_title

    alone = F.count("*").over(Window.partitionBy("source", "url")) == 1
    t = date_in_title(F.col("title"), F.col("_today"))
    out = df.withColumn("_t", t).withColumn("_alone", alone)
    out = out.withColumns({"title": F.coalesce("_t.name", "title"), "date": F.when(F.col("_t.date").isNotNull() & F.col("end").isNull() & F.col("_alone"), F.col("_t.date")).otherwise(F.col("date"))})
    parts = F.filter(F.transform(F.split("title", r"\s+[—|]\s+|\s*//\s*"), lambda p: F.trim(p)), lambda p: p != "")
    own = F.lower(F.regexp_replace("source", r"(?U)\W", ""))
    first = F.lower(F.regexp_replace(parts[0], r"(?U)\W", ""))
    pick = F.when((F.size(parts) > 1) & own.contains(first), parts[1]).otherwise(parts[0])
    keep = lambda new, old: F.when(F.length(new) >= 3, new).otherwise(old)
    out = out.withColumn("title", keep(pick, F.col("title")))
    venue = F.regexp_replace("source", r"\s*\(.*?\)", "")
    tail = F.lower(F.right("title", F.length(venue) + 3))
    bare = F.left("title", F.length("title") - F.length(venue) - 3)
    out = out.withColumn("title", keep(F.when((tail == F.lower(F.concat(F.lit(" - "), venue))) | (tail == F.lower(F.concat(F.lit(" – "), venue))), F.trim(bare)).otherwise(F.col("title")), F.col("title")))
    if "title_strip" in df.columns:
        own = F.trim(F.regexp_replace(F.col("title"), F.concat(F.lit("(?i)"), "title_strip"), F.lit("")))
        out = out.withColumn("title", F.when(F.col("title_strip").isNull(), F.col("title")).otherwise(keep(own, F.col("title"))))
    stripped = F.regexp_replace("title", rf"(?i)^(?:(?:ma|di|wo|do|vr|za|zo)[a-z]*\.?\s+)?\d{{1,2}}(?:\s*(?:t/m|-|–)\s*\d{{1,2}})?\s+(?:{_NAMES})\b\.?(?:\s+20\d\d)?\s*(?:v\.v\.|:|-|–)?\s*", "")
    stripped = F.regexp_replace(stripped, r"(?i)\s+\d{1,2}[:.]\d{2}(?:\s*(?:-|–|tot)\s*\d{1,2}[:.]\d{2})?\s*(?:uur)?\s*$", "")
    out = out.withColumn("title", keep(stripped, F.col("title")))
    film = F.trim(F.regexp_replace("title", r"(?i)\s+-\s+(filmvoorstelling|film|voorstelling)\b.*$|^film:\s*", ""))
    return out.withColumn("title", F.when(F.col("vtype") == "film", film).otherwise(F.col("title"))).drop("_t", "_alone")


def heading_guard(df: DataFrame) -> DataFrame:
    """A title on three or more pages of a source that under half of their addresses contain is a heading: the address's words replace it."""
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    key = F.left(flat(F.col("title")), F.lit(8))
    urls = df.select("source", "title", "url").distinct().withColumn("_in", flat(F.col("url")).contains(key))
    bad = urls.groupBy("source", "title").agg(F.count("*").alias("n"), F.count_if("_in").alias("k")).where("n >= 3 and k < n / 2").select("source", "title", F.lit(True).alias("_bad"))
    words = F.replace(F.element_at(F.split(F.regexp_replace(F.split("url", r"\?")[0], "/+$", ""), "/"), -1), F.lit("-"), F.lit(" "))
    words = F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 500))
    out = df.join(bad, ["source", "title"], "left")
    use = F.coalesce(F.col("_bad"), F.lit(False)) & (F.col("vtype") != "film") & ~words.rlike(r"^[\d\s]*$")
    return out.withColumn("title", F.when(use, words).otherwise(F.col("title"))).drop("_bad")


def content_filter(df: DataFrame, text: str, must: str, must_not: str) -> DataFrame:
    """Rows whose text has the source's wanted pattern and lacks its unwanted one; a null pattern asks nothing."""
    return df.where(F.expr(f"({must} is null or {text} rlike {must}) and ({must_not} is null or not {text} rlike {must_not})"))


def listing_with_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """listing(url, place, date, time?) × details(url, place, date, time, price): the k-th listing row of a date takes the
    k-th detail block if there are as many, else the only one of its time; others stay without."""
    at = Window.partitionBy("url", "date")
    l = listing.withColumns({"_k": F.row_number().over(at.orderBy("place")), "_n": F.count("*").over(at)})  # noqa: E741
    d = details.withColumns({"_k": F.row_number().over(at.orderBy("place")), "_m": F.count("*").over(at)})
    d = d.withColumn("_same", F.count("*").over(Window.partitionBy("url", "date", "time")))
    by_place = d.select("url", "date", "_k", "_m", F.col("time").alias("_time"), F.col("price").alias("_price"))
    out = l.join(by_place, ["url", "date", "_k"], "left")
    only = d.where("_same = 1").select("url", "date", "time", F.col("price").alias("_only"))
    out = out.join(only, ["url", "date", "time"], "left")
    paired = F.col("_n") == F.col("_m")
    return out.withColumns({"price": F.when(paired, F.col("_price")).otherwise(F.col("_only")), "time": F.when(paired, F.coalesce("time", "_time")).otherwise(F.col("time"))}).drop("_k", "_n", "_m", "_time", "_price", "_only")


#: What follows an act's name in titles, and words of programmes.
_DATED = rf"(?i)\s+(?:(?:komt|komen|staat|staan)\s+)?op\s+\d{{1,2}}\s+(?:{_NAMES})\.?(?:\s+\d{{4}})?\s*$"
_NOISE = r"(?i)(?:\s+(?:solo|live|in concert|unplugged|acoustic|akoestisch|with strings|with orchestra|luistersessie|listening session))+\s*$"
PROGRAMME = r"(?i)\s(ft\.?|feat\.?|featuring|presents?|met|with|spelen?|speelt|plays?)\s|,"


def search_names(name: Column, clean_least: int = 10) -> Column:
    """Names to look an artist up by, from the whole name to the act itself: array of (name, least popularity, part, unknown_ok).

    Each step is bound before the next one names it, as an expression is otherwise computed as often as it is named.
    """
    item = lambda n, short, least, part, unknown: F.struct(n.alias("name"), F.lit(short).alias("short"), (least if isinstance(least, Column) else F.lit(least)).alias("least"), F.lit(part).alias("part"), (unknown if isinstance(unknown, Column) else F.lit(unknown)).alias("unknown_ok"))

    def listed(bare: Column, first: Column, dated: Column, clean: Column, halves: Column, left: Column) -> Column:
        words = F.size(F.split(left, r"\s+"))
        base = F.array(item(F.trim(name), 3, 0, False, False), item(bare, 3, 0, False, False), item(first, 4, 0, False, False), item(dated, 4, 0, False, False), item(clean, 4, clean_least, False, False))
        colon = F.array(item(F.trim(F.split(clean, ":", 2)[0]), 4, 25, True, False), item(F.trim(F.coalesce(F.get(F.split(clean, ":", 2), F.lit(1)), F.lit(""))), 4, 0, True, False))
        pair = F.array(item(left, 4, F.when(words >= 2, 10).otherwise(40), False, words >= 2))
        none = F.filter(F.array(item(left, 4, F.lit(0), False, F.lit(False))), lambda x: F.lit(False))
        extra = F.when(clean.contains(":"), colon).when((F.size(halves) == 2) & ~left.contains(",") & ~left.rlike(PROGRAMME), pair).otherwise(none)
        return F.filter(F.concat(base, extra), lambda x: F.length(artist_key(x["name"])) >= x["short"])

    def distinct(every: Column) -> Column:
        firsts = let(F.transform(every, lambda x: x["name"]), lambda names: F.filter(every, lambda x, i: F.array_position(names, x["name"]) == i + 1))
        return F.transform(firsts, lambda x: F.struct(x["name"].alias("name"), x["least"].alias("least"), x["part"].alias("part"), x["unknown_ok"].alias("unknown_ok")))

    steps = (
        lambda: F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", "")), lambda bare: F.trim(F.split(bare, r"\s+[✦•|/–—]\s+|\s+-\s+")[0]), lambda bare, first: F.trim(F.regexp_replace(first, _DATED, "")),
        lambda bare, first, dated: F.trim(F.regexp_replace(dated, _NOISE, "")), lambda *known: F.split(known[-1], r"(?i)\s+(?:&|\+|en|and)\s+"), lambda *known: F.trim(known[-1][0]),
    )

    def bound(*known: Column) -> Column:
        return let(steps[len(known)](*known), lambda c: bound(*known, c)) if len(known) < len(steps) else let(listed(*known), distinct)

    return bound()


#: Titles that are no music, and series of comedy evenings.
NOT_MUSIC = (
    r"(?i)workshop|lezing|cursus|quiz|bingo|borrel|lunch|diner|rondleiding|open dag|proefles|clinic|filmavond|tentoonstelling|expositie|vergadering|netwerk|markt|\wbeurs\b|yoga|game night|jam ?sessi(e|on)|open (mic|podium|stage)|proeverij|proefavond|springkussen|boekenclub|(hedon|nacht) academy|publieke tribune|masterclass|^(ajax|vitesse)\s+-\s|"
    r"social dance|spelletjes|vaccinatie|science caf|subsidie|boekpresentatie|podcast|business club|\bmeeting\b|protestborden|woonprotest|stadssafari|crafternoon|design week|\bddw\b|cultuurnacht|museumnacht"
)
SERIES = r"(?i)comedy|cabaret|stand-?up|try-?out|conferen|caf[eé]\b|\bclub\b|night|train\b|kwis"


def link_eligibility(df: DataFrame) -> Column:
    """none, search (a link to a search) or lookup (resolve the artist) of rows with id, title, genre, type."""
    named = F.col("genre").isin("Cabaret", "Comedy")
    base = ~F.col("id").startswith("f") & ~F.col("type").isin("film", "expo", "fest") & ~F.col("title").rlike(NOT_MUSIC) & (named | ((F.col("type") == "pop") & ~F.col("genre").isin("Feest", "Lezing")))
    dash = F.regexp_replace("title", r"(?i)\s*\(festival(, dag \d)?\)$", "").contains(" - ") & F.col("genre").isin("Klassiek", "Cabaret", "Comedy", "Tribute")
    series = named & acts(F.col("title"))[0].rlike(SERIES)
    return F.when(~F.coalesce(base, F.lit(False)), "none").when(dash | series, "search").otherwise("lookup")


def page_text(pages: DataFrame, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(url, text), or other columns to keep: the visible text of a page's main part without navigation, hidden and other-event blocks, native."""
    body = F.regexp_replace("html", r"(?is)<(script|style|nav|header|footer|aside|form|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    main = F.coalesce(F.nullif(F.regexp_extract(body, r"(?is)<(main|article)\b[^>]*>(.*?)</\1\s*>", 2), F.lit("")), body)
    shown = F.regexp_replace(main, r"""(?is)<(\w+)[^>]*(?:\bhidden\b|display:\s*none)[^>]*>.*?</\1\s*>""", " ")
    from ..functions.keys import unescape

    text = F.trim(F.regexp_replace(unescape(F.regexp_replace(F.regexp_replace(shown, r"(?i)<(br|/p|/div|/li|/h\d)[^>]*>", "\n"), "<[^>]+>", " ")), r"[ \t\r]+", " "))
    return pages.select(*keep, once(text).alias("text"))


def once(c: Column) -> Column:
    """The same value through a one-element explode: the optimizer doesn't copy a long expression to wherever it is used."""
    return F.explode(F.array(c))


def event_from_page(pages: DataFrame, today: str) -> DataFrame:
    """(url, title, date, end, doors, start, time, price, status) of event pages; dates over a year ago are none."""
    from ..functions.extract import clock_times

    t = F.lit(today).cast("date")
    title = F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>\s*([^<]+?)\s*</h1>", 1))
    rows = page_text(pages.select("url", "html", title.alias("title")), ("url", "title"))
    rows = with_date(rows.withColumn("head", F.left("text", F.lit(6000))), "head", t)
    rows = rows.withColumn("date", once(F.col("date"))).where((F.datediff(t, "date") <= 365) & (F.col("title") != "")).withColumn("_c", once(clock_times(F.col("head"))))
    rows = rows.withColumns({"end": until_date(F.col("head"), F.col("date")), "price": price_from_text(F.col("head")), "status": sale_status(F.col("head"))})
    return rows.select("url", "title", "date", "end", F.col("_c.doors").alias("doors"), F.col("_c.start").alias("start"), F.coalesce("_c.start", "_c.doors", "_c.first").alias("time"), "price", "status")

