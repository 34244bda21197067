"""Key and normalisation columns, the join keys of every other operator.

They differ on purpose: some cut, some fold accents, some don't.
"""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a mark and what they fold to, made from the Unicode tables for the Latin blocks.
_MARKED = {chr(c): d for c in range(0x00C0, 0x0250) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)}
_MARKED |= {chr(c): d for c in range(0x1E00, 0x1F00) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)}
#: Letters that no decomposition covers.
_SPECIAL = {"ø": "o", "đ": "d", "ł": "l", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss", "ð": "d", "þ": "th"}
#: Spellings of the same city.
CITY_ALIASES = {"den bosch": "s hertogenbosch", "s hertogenbosch": "s hertogenbosch", "den haag": "s gravenhage", "s gravenhage": "s gravenhage"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_marks(c: Column | str) -> Column:
    """Drop combining marks, also those inside precomposed Latin letters."""
    return F.regexp_replace(F.translate(col(c), "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}+", "")


def unescape(c: Column | str) -> Column:
    """The named references that texts use and decimal ones of ASCII punctuation; ``&amp;`` last."""
    named = {f"&{n};": html.unescape(f"&{n};") for n in ("quot", "apos", "lt", "gt", "nbsp", "euro", "eacute", "egrave", "euml", "iuml", "ouml", "uuml", "auml", "ccedil", "ndash", "mdash", "hellip", "rsquo", "lsquo", "rdquo", "ldquo", "copy", "middot")}
    named |= {f"&#{n};": chr(n) for n in (34, 39, 8211, 8212, 8216, 8217, 8220, 8221, 8230)} | {"&#039;": "'", "&#x27;": "'", "&#38;": "&", "&#038;": "&", "&amp;": "&"}
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), named.items(), col(c))


def slug(c: Column | str) -> Column:
    """Lower case, runs of other characters as a hyphen, 48 characters at most; accents aren't folded."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(48))


def norm14(c: Column | str) -> Column:
    """The first 14 letters and digits; long titles collide by design."""
    return F.left(F.regexp_replace(F.lower(unescape(c)), "[^a-z0-9]+", ""), F.lit(14))


def artist_key(c: Column | str) -> Column:
    return F.regexp_replace(fold_marks(F.lower(col(c))), "[^a-z0-9]", "")


def headline(c: Column | str) -> Column:
    """The part of a title that names the act."""
    plain = F.regexp_replace(col(c), r"(?i)\s*\(festival(, dag \d)?\)$", "")
    return F.trim(F.split(F.split(plain, " ✦ ")[0], " - ")[0])


def first_act(c: Column | str) -> Column:
    return artist_key(F.regexp_replace(F.split(headline(c), r"\s[+/]\s")[0], r"\s*\([^)]*\)", ""))


def film_key(c: Column | str) -> Column:
    """A film's title without the series it is shown in, year or premiere note."""
    bare = F.regexp_replace(unescape(c), r"(?i)^(film\w*|beschouwfilm|film ?&[^:]*)(\s+[^:]{0,25})?:\s*", "")
    bare = F.split(bare, r"\s+[—|-]\s+")[0]
    return artist_key(F.regexp_replace(bare, r"(?i)\((19|20)\d\d\)|\((voor)?premi[eè]re\)", ""))


def title_tokens(c: Column | str) -> Column:
    """The set of ASCII words of a title, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(fold_marks(unescape(c))), r"[^\x00-\x7f]", ""), F.lit("([a-z0-9]+)"), F.lit(1)))


def compare_key(c: Column | str) -> Column:
    """For comparing artist names: "and" in any spelling and a leading "the" don't count."""
    spelled = F.regexp_replace(F.lower(col(c)), "[&+]", " and ")
    words = F.filter(F.split(spelled, r"\s+"), lambda w: ~w.isin("and", "en", "und", "et", ""))
    key = artist_key(F.array_join(words, ""))
    return F.when(key.startswith("the") & (F.length(key) > 6), F.substring(key, 4, 1 << 20)).otherwise(key)


def search_fold(c: Column | str) -> Column:
    """For searching: no case, accents, special letters, curly quotes or zero-width characters."""
    out = fold_marks(F.lower(col(c)))
    out = F.regexp_replace(out, "[­​-‍﻿]", "")
    for a, b in _SPECIAL.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "‘’ʼ`´“”„", "'''''\"\"\"")


def city_key(c: Column | str) -> Column:
    key = F.trim(F.regexp_replace(fold_marks(F.lower(F.coalesce(col(c), F.lit("")))), "[^a-z]+", " "))
    alias = F.create_map(*(F.lit(x) for kv in CITY_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(alias, key), key)


def url_host(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?i)^https?://([^/?#]+)", 1)), r"^www\.", "")


def url_page(c: Column | str) -> Column:
    """A URL without query and trailing slashes."""
    return F.regexp_replace(F.split(col(c), r"\?")[0], "/+$", "")


def event_id(source: Column | str, when: Column | str, title: Column | str, time: Column | None = None) -> Column:
    """A stable id from what identifies a show; films carry their time as well."""
    base = F.concat_ws("|", col(source), col(when).cast("string"), col(title))
    base = base if time is None else F.concat(base, F.coalesce(F.concat(F.lit("|"), time), F.lit("")))
    return F.concat(F.lit("s"), F.left(F.sha1(base), F.lit(10)))


def venue_group(name: Column | str, city: Column | str) -> Column:
    return F.lower(F.concat_ws("|", col(name), col(city)))


def acts(title: Column | str, support: Column | None = None) -> Column:
    """The acts that a title and its support list name."""
    t = col(title)
    instore = F.regexp_extract(t, r"Instore:\s*(.+)$", 1)
    listed = F.transform(F.split(F.regexp_replace(headline(t), r"^Popronde:\s*", ""), r"\s\+\s"), lambda x: F.trim(x))
    out = F.when(instore != "", F.array(instore)).otherwise(listed)
    return out if support is None else F.array_union(out, F.coalesce(support, F.array().cast("array<string>")))


#: Words that make a title part no production of its own.
_REST = r"(?i)\b(tour|tournee|try-?out|reprise|premi[eè]re|extra|live|concert|show|uitverkocht|release|album|presentatie|jubileum|special|editie|edition|deel|part|kerst|oudejaars|nieuwjaars)\b"


def tour_keys(title: Column | str) -> Column:
    """The act's key, and the production's where a title is "maker - production" with a telling name."""
    t = F.regexp_replace(col(title), r"\s*\([^)]*\)", "")
    rest = F.trim(F.coalesce(F.get(F.split(t, " - "), F.lit(1)), F.lit("")))
    key = artist_key(rest)
    telling = (F.length(key) >= 10) & (F.size(F.split(rest, r"\s+")) >= 2) & ~rest.rlike(_REST)
    own = artist_key(acts(title)[0])
    return F.array_distinct(F.when(telling, F.array(own, key)).otherwise(F.array(own)))


def bare_key(c: Column | str) -> Column:
    """For audits: letters and digits outside brackets."""
    return F.regexp_replace(F.lower(F.regexp_replace(col(c), r"\s*\([^)]*\)", "")), "[^a-z0-9]", "")
