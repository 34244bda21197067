"""References of web pages as columns: parsing and resolving by RFC 3986."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, AUTHORITY, PATH, QUERY, FRAGMENT = range(1, 6)
#: Each of the parts alone, reading no farther than it goes.
_ALONE = (r"^([A-Za-z][A-Za-z0-9+.-]*):", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", r"^[^?#]*\?([^#]*)", r"(?s)^[^#]*#(.*)$")


def part(url: Column, which: int) -> Column:
    """A part of a reference; what is absent is empty."""
    return F.regexp_extract(url, _ALONE[which - 1], 1)


def host(url: Column) -> Column:
    """The authority without www."""
    return F.regexp_replace(part(url, AUTHORITY), r"^www\.", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^([^#]*)", 1)


def without_dots(path: Column) -> Column:
    """Dot segments removed: a fold over the segments that steps back on each ``..``, never above the root."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    back = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", back(kept)).otherwise(F.concat(kept, F.array(s)))
    folded = F.aggregate(F.slice(segments, 2, F.size(segments)), F.slice(segments, 1, 1), step)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.array_join(folded, "/")).otherwise(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parsed(url: Column) -> Column:
    """The parts of a reference as a struct; query and fragment with their mark, so that an empty one isn't an absent one."""
    scheme = F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?", 1)
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?", 1)
    return F.struct(scheme.alias("scheme"), authority.alias("authority"), part(url, PATH).alias("path"), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1).alias("query"), F.regexp_extract(url, r"(?s)^[^#]*(#.*)?$", 1).alias("fragment"))


def resolve(base: Column, reference: Column) -> Column:
    """The reference in full, as seen from ``base``, an absolute url; null if either is."""
    ref = F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", "")

    def seen(b: Column, r: Column) -> Column:
        root = F.concat(b["scheme"], F.lit(":"), b["authority"])
        folder = F.when(b["path"] == "", F.lit("/")).otherwise(F.regexp_extract(b["path"], r"(?s)^(.*/)", 1))
        path = F.when((r["scheme"] != "") | (r["authority"] != "") | r["path"].startswith("/"), r["path"]).otherwise(F.concat(folder, r["path"]))
        start = F.when(r["scheme"] != "", F.concat(r["scheme"], F.lit(":"), r["authority"])).when(r["authority"] != "", F.concat(b["scheme"], F.lit(":"), r["authority"])).otherwise(root)
        same = (r["scheme"] == "") & (r["authority"] == "") & (r["path"] == "")
        return F.when(same, F.concat(root, b["path"], F.when(r["query"] != "", r["query"]).otherwise(b["query"]), r["fragment"])).otherwise(F.concat(start, let(path, without_dots), r["query"], r["fragment"]))

    return F.when(base.isNotNull() & reference.isNotNull(), let(parsed(base), lambda b: let(parsed(ref), lambda r: seen(b, r))))
