"""Facts from Dutch and English text as column expressions: dates, periods, times, amounts, prices, status, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names and abbreviations as sites write them.
MONTHS = {
    "januari": 1, "februari": 2, "maart": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "augustus": 8, "september": 9, "oktober": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mrt": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "okt": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "august": 8, "october": 10, "oct": 10, "mar": 3,
}
#: Months that only Dutch text names; English ones stand before the day too, "may" then only as May.
DUTCH_MONTHS = ("januari", "februari", "maart", "mrt", "mei", "juni", "juli", "augustus", "okt", "oktober", "may")
_ordered = lambda names: "|".join(sorted(names, key=lambda m: (-len(m), m)))
_NAMES, _ENGLISH = _ordered(MONTHS), _ordered(m for m in MONTHS if m not in DUTCH_MONTHS)
_NUMERIC = r"\b\d{1,2}[-/.]\d{1,2}[-/.]20\d\d\b"
_DAY_MONTH = rf"\b\d{{1,2}}\s+(?:{_NAMES})\.?\b(?:\s*,?\s+'?(?:\d{{4}}|\d\d)(?![:.]\d)(?!\s*u(?:ur)?\b))?\b"
_MONTH_DAY = rf"\b(?:(?-i:May)|{_ENGLISH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?\b(?![:.]\d)(?:,?\s+20\d\d)?"
#: Any date that names its month, in one scan of a text.
DATES = rf"(?i){_NUMERIC}|{_DAY_MONTH}|{_MONTH_DAY}"


def month_number(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    return F.try_element_at(table, F.lower(name))


def _date(y: Column, m: Column, d: Column) -> Column:
    """The day of three numbers; null if there is none."""
    first = F.when((m >= 1) & (m <= 12) & (y >= 1) & (y <= 9999), F.make_date(y, m, F.lit(1)))
    return F.when((d >= 1) & (d <= F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1))


def infer_year(m: Column, d: Column, today: Column, back: int = 60) -> Column:
    """A date without a year: this year's, or next year's if that is over ``back`` days ago."""
    this = _date(F.year(today), m, d)
    return F.when(F.datediff(today, this) > back, _date(F.year(today) + 1, m, d)).otherwise(this)


def groups(text: Column, pattern: str, n: int) -> Column:
    """Struct of a pattern's groups g1..gn (null where empty) and ``at``, the place of its first match (0: none)."""
    return F.struct(F.regexp_instr(text, F.lit(pattern)).alias("at"), *(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).alias(f"g{k}") for k in range(1, n + 1)))


def first_date(text: Column, today: Column) -> Column:
    """The first date in a text that exists. Years of two digits are 20xx.

    Each match of DATES is cut in its words, the words are read as numbers, and the numbers made a date, in steps, as
    an array function evaluates what it names as often as it names it.
    """
    words = F.transform(F.regexp_extract_all(text, F.lit(DATES), F.lit(0)), lambda x: F.split(x, r"[\s,.'/-]+"))

    def numbers(w: Column) -> Column:
        a, b, y = F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.get(w, F.lit(2)).try_cast("int")
        first = a.try_cast("int")
        day = F.coalesce(first, F.translate(b, "stndrhSTNDRH", "").try_cast("int"))
        month = F.when(first.isNull(), month_number(a)).otherwise(F.coalesce(b.try_cast("int"), month_number(b)))
        return F.struct(F.when(y < 100, 2000 + y).otherwise(y).alias("y"), month.alias("m"), day.alias("d"))

    dates = F.transform(F.transform(words, numbers), lambda n: F.when(n["y"].isNotNull(), _date(n["y"], n["m"], n["d"])).otherwise(infer_year(n["m"], n["d"], today)))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def with_date(df: DataFrame, text: str, today: Column, out: str = "date") -> DataFrame:
    """Add the date that a text column gives: what stands right after "datum", also without a month's name or a year, or
    else the first in the text."""
    after = F.nullif(F.regexp_extract(text, r"(?is)\bdatum\s*:?\s*(.{0,40})", 1), F.lit(""))
    short = r"(?i)^(?:[a-z]{2,9}\.?\s+)?(\d{1,2})[-/.](\d{1,2})(?![-/.]?\d)"
    number = lambda k: F.regexp_extract(F.col("_after"), short, k).try_cast("int")
    df = df.withColumns({"_after": after, "_today": today})
    labelled = F.when(F.col("_after").isNotNull(), F.coalesce(first_date(F.col("_after"), F.col("_today")), infer_year(number(2), number(1), F.col("_today"))))
    return df.withColumn(out, F.coalesce(labelled, first_date(F.col(text), F.col("_today")))).drop("_after", "_today")


def parse_iso(text: Column) -> tuple[Column, Column]:
    """(date, HH:MM) of an ISO time; Z becomes Amsterdam's clock, other offsets are ignored, midnight is no time."""
    stamp = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d)", 0)
    local = F.try_to_timestamp(F.replace(F.nullif(stamp, F.lit("")), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm"))
    local = F.when(text.rlike(r"Z$"), F.from_utc_timestamp(local, "Europe/Amsterdam")).otherwise(local)
    date = F.coalesce(F.to_date(local), F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)", 1), "yyyy-MM-dd"))
    clock = F.date_format(local, "HH:mm")
    return date, F.when(clock != "00:00", clock)


#: Weekday abbreviations, Monday first.
WEEKDAYS = ("ma", "di", "wo", "do", "vr", "za", "zo")


def date_in_title(title: Column, today: Column) -> Column:
    """Struct of name and date for "Name ✦ do 18 feb ✦ Hall", if the weekday fits this or next year; else null."""
    p = rf"(?i)^(.*?)\s+✦\s+({'|'.join(WEEKDAYS)})\w*\.?\s+(\d{{1,2}})\s+({_NAMES})\b"
    m, d = month_number(F.regexp_extract(title, p, 4)), F.regexp_extract(title, p, 3).try_cast("int")
    wanted = F.array_position(F.array(*(F.lit(w) for w in WEEKDAYS)), F.lower(F.regexp_extract(title, p, 2))) - 1
    ok = lambda c: F.when((F.weekday(c) == wanted) & (F.datediff(c, today) >= -1), c)
    found = F.coalesce(ok(_date(F.year(today), m, d)), ok(_date(F.year(today) + 1, m, d)))
    return F.when(found.isNotNull(), F.struct(F.trim(F.regexp_extract(title, p, 1)).alias("name"), found.alias("date")))


def until_date(text: Column, start: Column) -> Column:
    """The end of "t/m 12 maart": in the year of the start, or the next if that lies before it, within 330 days."""
    p = rf"(?i)\b(?:t/m|tot en met|until)\s+(?:\w{{2,9}}\s+)?(\d{{1,2}})\s+({_NAMES})\b(?:\s+(20\d\d))?"
    g = lambda k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    d, m, y = g(1).cast("int"), month_number(g(2)), g(3).cast("int")
    own = _date(F.coalesce(y, F.year(start)), m, d)
    end = F.when(y.isNull() & (own < start), _date(F.year(start) + 1, m, d)).otherwise(own)
    return F.when((F.datediff(end, start) >= 0) & (F.datediff(end, start) < 330), end)


def clock_times(text: Column) -> Column:
    """Struct of doors, start and first time (HH:MM) that a text names."""
    clock = lambda p: _clock(F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2))
    t = r"(\d{1,2})[:.](\d\d)"
    return F.struct(
        clock(rf"(?i)\b(?:deur(?:en)?(?: open)?|zaal open|doors)\b[^\d]{{0,20}}{t}").alias("doors"),
        clock(rf"(?i)\b(?:aanvang|start|begin|show)\b[^\d]{{0,20}}{t}").alias("start"),
        clock(rf"(?<![\d.,€]){t}(?![\d.,])").alias("first"),
    )


def _clock(h: Column, m: Column) -> Column:
    hour, minute = h.try_cast("int"), m.try_cast("int")
    return F.when((hour < 24) & (minute < 60), F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))


_AMOUNT = r"^(\d{1,3}(?:\.\d{3})+|\d+)(?:[,.](\d{1,2}|-{1,2}))?$"


def amount(text: Column) -> Column:
    """"€ 24,50", "24,-" or "1.250,00" as a number, else null."""
    return bare_amount(without_marks(text))


def without_marks(text: Column) -> Column:
    """An amount without space and the signs of its currency."""
    return F.regexp_replace(text, r"(?i)\s|€|eur(os?)?\b", "")


def bare_amount(bare: Column) -> Column:
    euros = F.replace(F.regexp_extract(bare, _AMOUNT, 1), F.lit("."), F.lit("")).try_cast("double")
    cents = F.regexp_extract(bare, _AMOUNT, 2)
    part = F.when(cents.rlike(r"^\d"), F.rpad(cents, 2, "0").try_cast("double") / 100).otherwise(0.0)
    return F.when(bare.rlike(_AMOUNT), F.round(euros + part, 2))


#: Words that say an amount isn't the price of a ticket, words that say it is, and wordings of free entry.
NO_TICKET = r"(?i)servicekosten|service ?fee|transactie|administratie|reserveringskosten|garderobe|parkeer|parking|consumptie|munt|drank|diner|menu|arrangement|hotel|toeslag|cadeau|gift|lidmaatschap|merch|programmaboekje|korting van|bespaar|donatie|fooi"
LABELS = r"entree|entrée|toegang|toegangsprijs|entreeprijs|prijs|prijzen|kaarten|kaartprijs|tickets?|ticketprijs|voorverkoop|kassa|regulier|normaal|vanaf|v\.a\."
EURO = r"(?:€\s*\d{1,3}(?:[.,]\d{2}|,-{1,2})?(?![\d.,]*\d)|\d{1,3}(?:[.,]\d{2})?\s*(?:euro|eur)\b)"
FREE = r"(?i)\b(?:(?:entree|entrée|toegang|toegangsprijs|entreeprijs|prijs|kaarten|tickets?)\s*:?\s*(?:is\s+)?(?:gratis|vrij|free)\b(?!\s+(?:voor|met|bij|tot|t/m|onder|vanaf|na)\b)|(?:gratis|vrije?)\s+(?:entree|entrée|toegang)\b(?!\s+(?:voor|met|bij|tot|t/m|onder|vanaf|na)\b)|free\s+(?:entry|entrance|admission)\b)"
FEES = r"(?i)\b(?:excl|incl|exclusief|inclusief|ex|plus)\.?\s*(?:\w+\s+){0,2}(?:servicekosten|service ?fee|transactiekosten|reserveringskosten|administratiekosten)"
LOWEST, HIGHEST = 1, 500


def price_from_text(text: Column) -> Column:
    """The lowest labelled amount, else the only loose amount, else 0 if entry is free and no amount is given, else null."""
    t = F.regexp_replace(text, FEES, "")
    around = lambda p: F.regexp_extract_all(t, F.lit(rf"(?is)(.{{0,30}}(?:{p}).{{0,20}})"), F.lit(1))
    pay = lambda found: F.filter(F.transform(F.filter(found, lambda x: ~x.rlike(NO_TICKET)), lambda x: amount(F.regexp_extract(x, rf"(?i)({EURO})", 1))), lambda a: (a >= LOWEST) & (a <= HIGHEST))
    labelled = pay(around(rf"\b(?:{LABELS})(?<=\w|\.)[^\n€\d]{{0,15}}?{EURO}"))
    every = F.regexp_extract_all(t, F.lit(rf"(?i)({EURO})"), F.lit(1))
    loose = F.array_distinct(pay(around(EURO)))
    return F.when(F.size(labelled) > 0, F.array_min(labelled)).when((F.size(loose) == 1) & (F.size(every) <= 2), loose[0]).when((F.size(every) == 0) & t.rlike(FREE), 0.0)


def sale_status(text: Column, offers: Column | None = None, event_status: Column | None = None) -> Column:
    """sold or cancelled, as the structured status, the offers or the text say."""
    o = F.coalesce(offers, F.lit("")) if offers is not None else F.lit("")
    s = F.coalesce(event_status, F.lit("")) if event_status is not None else F.lit("")
    head = F.left(F.coalesce(text, F.lit("")), F.lit(800))
    cancelled = s.rlike("(?i)cancel") | head.rlike(r"(?i)\b(geannuleerd|gaat niet door|afgelast|cancelled)\b")
    sold = o.rlike("(?i)soldout") | text.rlike(r"(?i)\b(uitverkocht|sold ?out)\b")
    return F.when(cancelled, "cancelled").when(F.coalesce(sold, F.lit(False)), "sold")


def clean_act_list(text: Column) -> Column:
    """A list of names; none and to-be-announced are no names."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s*(?:,|\+|&|/|\ben\b)\s*"), lambda x: F.trim(x))
    return F.filter(names, lambda x: (x != "") & ~x.rlike(r"(?i)^(geen|none|n\.?v\.?t\.?|tba|t\.?b\.?a\.?|n\.?t\.?b\.?|nader te bepalen)$"))


#: Headings that name no show.
GENERIC = r"(?i)^(agenda|programma|home|evenementen?|events?|concerten|voorstellingen|tickets?|menu)$"


def clean_title(title: Column, site: Column) -> Column:
    """A page's title without the site's name, what follows its last bar, or the day and place of the show."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    name = F.regexp_replace(F.coalesce(site, F.lit("")), r"([^\w\s])", r"\\$1")
    own = F.regexp_replace(t, F.concat(F.lit(r"(?i)\s*[|–—:-]\s*"), name, F.lit(r"\s*$")), F.lit(""))
    t = F.when(name != "", own).otherwise(t)
    t = F.when(t.rlike(r"\s[|–—]\s"), F.regexp_replace(t, r"\s*[|–—]\s*[^|–—]{2,40}$", "")).otherwise(t)
    t = F.regexp_replace(t, r"(?i)\s+(op|on|in|at|@)\s+(ma|di|wo|do|vr|za|zo|maandag|dinsdag|woensdag|donderdag|vrijdag|zaterdag|zondag)?\.?\s*\d{1,2}[\s./-]+\w+[\s./-]+\d{2,4}\b.*$", "")
    at = F.regexp_replace(t, F.concat(F.lit(r"(?i)\s+(naar|in|bij|live in|@)\s+"), name, F.lit(".*$")), F.lit(""))
    return F.regexp_replace(F.when(name != "", at).otherwise(t), r"^[ \-|!]+|[ \-|!]+$", "")


def pick_title(h1: Column, og: Column, page: Column, url: Column, site: Column) -> Column:
    """The first usable of heading, shared title and page title, cleaned, else the address's last words."""

    def usable(c: Column) -> Column:
        t = clean_title(c, site)
        return F.when((F.length(t) >= 2) & ~t.rlike(GENERIC) & (F.lower(t) != F.lower(F.coalesce(site, F.lit("")))), t)

    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(F.split(url, r"[?#]")[0], "^[a-z]+://[^/]*", ""), "/+$", ""), "/"), -1)
    words = F.trim(F.regexp_replace(F.regexp_replace(last, r"^\d+-|-\d+$|\.\w+$", ""), "[-_]+", " "))
    return F.coalesce(usable(h1), usable(og), usable(page), F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 500)))
