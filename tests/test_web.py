"""Links, sitemaps and offers against the standard's tables and plain versions."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from evenloom.functions import urls as U
from evenloom.operators import web as W

BASE = "http://a/b/c/d;p?q"
#: The examples of RFC 3986, 5.4.1 and 5.4.2 (strict).
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_resolve_by_the_standards_examples(spark):
    df = spark.createDataFrame(list(EXAMPLES.items()), "ref string, want string")
    got = df.select("ref", "want", U.resolve(F.lit(BASE), F.col("ref")).alias("got")).collect()
    assert {r.ref: r.got for r in got} == EXAMPLES
    odd = spark.createDataFrame([("http://h", "x", "http://h/x"), ("http://h", "?a", "http://h?a"), ("http://h/a?b", "?", "http://h/a?"), (None, "x", None), ("http://h/", None, None), ("http://h/a", "  b\n", "http://h/b"), ("http://h/a/", "é b", "http://h/a/é b")], "b string, r string, want string")
    assert all(r.got == r.want for r in odd.select("want", U.resolve(F.col("b"), F.col("r")).alias("got")).collect())


def links(spark, html, url="https://www.v.example/programma/lijst", **kw):
    rows = W.detail_links(spark.createDataFrame([(url, html)], "url string, html string"), **kw).orderBy("place").collect()
    return [r.link for r in rows]


def test_detail_links(spark):
    site = "https://www.v.example"
    html = """<a href="/agenda/show-1#x">1</a><a class='a>b' href='show/../concert/abc'>2</a><a href=/agenda/show-1>again</a><!-- <a href="/agenda/hidden">h</a> --><script>'<a href="/agenda/script">'</script>
        <a href="https://v.example/film/naam?x=1&amp;y=2">3</a><a href="https://other.example/agenda/abc">o</a><a href="/agenda/x/page/2">p</a><a href="/agenda/poster.jpg">j</a><a href="mailto:a@b">m</a><a data-href="/agenda/data">d</a><a name=x>n</a><area href="/agenda/area">"""
    assert links(spark, html) == [f"{site}/agenda/show-1", f"{site}/programma/concert/abc", "https://v.example/film/naam?x=1&y=2"]
    assert links(spark, '<head><base href="/"></head><a href="agenda/abc">1</a><a href="../agenda/def">2</a>') == [f"{site}/agenda/abc", f"{site}/agenda/def"]
    assert links(spark, '<div data-target="/event/abc"></div><a href="/agenda/abc">1</a><DIV DATA-TARGET="/event/abc">', attributes=("data-target",)) == [f"{site}/agenda/abc", f"{site}/event/abc"]
    assert links(spark, '<a href="/?post_type=events&p=153705">1</a><a href="/about">2</a>', pattern=r"[?&]p=\d+") == [f"{site}/?post_type=events&p=153705"]
    assert links(spark, '<a href="/programma/lijst/">self</a><a href="">self</a><a href="#top">self</a>', pattern=".") == []
    assert links(spark, None) == [] and links(spark, "<a href=/agenda/abc>", url=None) == []
    two = spark.createDataFrame([("https://a.example/", '<a href="/x/1">', "^/x"), ("https://b.example/", '<a href="/x/1"><a href="/show/abc">', None)], "url string, html string, p string")
    assert sorted(r.link for r in W.detail_links(two, F.col("p")).collect()) == ["https://a.example/x/1", "https://b.example/show/abc"]
    assert len(links(spark, "<a " + "x" * 200_000 + ' href="/agenda/abc">')) == 1  # no stack overflow


def plain_tree(start, docs, most):
    """Breadth first, as read one after the other; docs: url -> (children, links)."""
    todo, seen, found = deque([start]), [], {}
    while todo and len(seen) < most:
        at = todo.popleft()
        if at in seen:
            continue
        seen.append(at)
        children, entries = docs.get(at, ([], []))
        todo.extend(c for c in children if not c.endswith(".gz"))
        for link, mod in entries:
            found.setdefault(link, mod)
    return sorted(found, key=lambda u: found[u], reverse=True)


@pytest.mark.parametrize("most", [1, 2, 4, 25])
def test_sitemap_tree_equals_reading_one_after_the_other(spark, most):
    s = "https://s.example/"
    docs = {
        s + "0": ([s + "1", s + "2", s + "old.gz", s + "0", s + "missing"], [(s + "show/a00", "2024-01-01")]), s + "1": ([s + "3", s + "2"], [(s + "show/b00", "")]),
        s + "2": ([s + "1", s + "4"], [(s + "show/a00", "2025-01-01"), (s + "show/c00", "2024-01-01")]), s + "3": ([s + "0"], [(s + "show/d00", "2023-05-05"), (s + "show/c00", "2022-01-01")]), s + "4": ([s + "5"], [(s + "show/e00", "2024-01-01")]), s + "5": ([], [(s + "show/f00", "")]),
    }
    xml = lambda c, e: "<x>" + "".join(f"<sitemap><loc> {u}</loc></sitemap>" for u in c) + "".join(f"<url><loc>{u}</loc>{f'<lastmod>{m}</lastmod>' if m else ''}</url>" for u, m in e)
    maps = spark.createDataFrame([(u, xml(*d)) for u, d in docs.items()] + [("https://t.example/0", None)], "url string, xml string")
    sites = spark.createDataFrame([("s", s + "0"), ("t", "https://t.example/0"), ("u", "https://u.example/none")], "site string, url string")
    got = W.sitemap_tree(sites, maps, max_maps=most).orderBy("rank").collect()
    assert [r.link for r in got] == plain_tree(s + "0", docs, most) and {r.site for r in got} == {"s"}


def plain_price(event):
    """The lowest price by recursion over the parsed object."""
    import re

    from evenloom.functions.extract import NO_TICKET

    if event.get("isAccessibleForFree") in (True, "true", "True", "https://schema.org/True"):
        return 0.0
    found, free = [], []

    def walk(o):
        if isinstance(o, list):
            for x in o:
                walk(x)
        elif isinstance(o, dict):
            words = " ".join(str(o.get(k) or "") for k in ("name", "description", "category"))
            if str(o.get("priceCurrency") or "EUR").upper() == "EUR" and not re.search(NO_TICKET, words):
                for k in ("lowPrice", "price"):
                    if o.get(k) is not None and re.fullmatch(r"\d+(\.\d+)?", str(o[k])):
                        p = float(o[k])
                        if p == 0:
                            free.append(bool(re.search("(?i)gratis|free|vrij", words)))
                        elif 1 <= p <= 500:
                            found.append(p)
                        break
            walk(o.get("offers"))
            walk(o.get("priceSpecification"))

    walk(event.get("offers"))
    return min(found) if found else 0.0 if any(free) else None


def test_offers_of_any_depth(spark):
    import json
    import random

    rng = random.Random(5)

    def node(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.15:
            return rng.choice([None, "text", 5, {"price": str(rng.randint(0, 600))}, {"lowPrice": rng.randint(1, 30), "price": 1}, {"price": 0, "name": "Gratis entree"}, {"price": 2, "category": "Servicekosten"}, {"price": 1, "priceCurrency": "USD"}])
        if kind < 0.4:
            return [node(depth - 1) for _ in range(rng.randint(0, 3))]
        out = {"offers": node(depth - 1)}
        if kind > 0.7:
            out["priceSpecification"] = node(depth - 1)
        if kind > 0.9:
            out["price"] = str(rng.randint(100, 700))
        return out

    events = [{"offers": node(rng.randint(0, 11))} for _ in range(120)] + [{}, {"offers": None}, {"isAccessibleForFree": "True", "offers": {"price": 9}}, {"isAccessibleForFree": False}]
    rows = [(k, json.dumps(e)) for k, e in enumerate(events)] + [(-1, None), (-2, "no json"), (-3, "[1]")]
    got = {r.k: r.price for r in W.event_prices(spark.createDataFrame(rows, "k long, event string"), "k", "event").collect()}
    assert got == {**{k: plain_price(e) for k, e in enumerate(events)}, -1: None, -2: None, -3: None}
