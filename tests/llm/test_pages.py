"""Archives and extraction of pages."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from evenloom.llm import htmltext, warc

BIG = "<p>" + "long text " * 20000 + "</p>"
PAGES = [(1, "http://a.example/x", "<p>one</p>"), (4, "http://a.example/y", "<p>one</p>"), (2, None, None), (3, "http://b.example/\r\nX: y", ""), (6, "u", BIG), (5, "u", "é🙂"), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (4, "again", "<p>one</p>")]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], "page_id long, url string, html string, digest string, n int, archive int")


def test_warc_round_trip(spark):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame(spark, PAGES)).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        last = max(j for j, _, g in PAGES if (g or "").encode() == data)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == last else "revisit", None if i == last else last))
    assert got == sorted(want, key=str)
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_warc_deals_rows_without_an_id(spark):
    rows = [(None, f"http://x/{k % 7}", f"<p>{k % 50}</p>" if k % 3 else None) for k in range(300)] + [(k, None, "") for k in range(40)]
    root = warc.shared_dir(spark).rstrip("/") + "/warc-test"
    archives = warc.write_archives(frame(spark, rows), root, archive_bytes=20_000)
    assert archives.count() > 5 and sum(r.n_records for r in archives.collect()) == len(rows)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.read_records(warc.normalise_archives(archives, root)).collect())
    last = {h or "": max((i for i, _, g in rows if (g or "") == (h or "") and i is not None), default=None) for _, _, h in rows}
    want = [(str(i), len(h or ""), "response" if i == last[h or ""] else "revisit", "None" if i == last[h or ""] else str(last[h or ""])) for i, _, h in rows]
    assert got == sorted(want)


def test_reports_read_members_in_chunks():
    big = bytes(range(256)) * 3000
    data = gzip.compress(warc.record(5, "u", big, warc.base32_sha1(big), None))
    stream = io.BytesIO(b"before" + data + b"after")
    assert warc.payload_report(warc.Part(stream, 6, len(data))) == (5, len(big), warc.base32_sha1(big), "response", None)
    wrong = gzip.compress(warc.record(5, "u", big, warc.base32_sha1(b""), None))
    with pytest.raises(ValueError):
        warc.payload_report(warc.Part(io.BytesIO(wrong), 0, len(wrong)))


def test_normaliser_makes_members_that_stand_alone():
    records = [warc.record(k, f"http://x/{k}", p, warc.base32_sha1(p), None) for k, p in enumerate((b"", b"abc" * 50000, b"\r\n\r\n", bytes(range(256))))]
    out = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), out))
    data = out.getvalue()
    assert [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in index] == records
    assert gzip.decompress(data) == b"".join(records)
    several = b"".join(gzip.compress(r) for r in records)  # an archive that has members already
    assert [e["record_id"] for e in warc.normalise(io.BytesIO(several), io.BytesIO())] == [warc.record_id(k) for k in range(4)]
    with pytest.raises(EOFError):
        list(warc.normalise(io.BytesIO(gzip.compress(b"".join(records))[:-30]), io.BytesIO()))


ARTICLE = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></ul></nav><div class='ad'>Buy now</div><article><h1>Head &amp; tail</h1><p>First\n  para<b> bold</b>.<p>Second<br>line</p><aside>Tip</aside><form>Name</form><!-- no --></article><div id=comments>Nice!</div><footer>&copy; x</footer></body></html>"


def test_article_text():
    assert htmltext.main_texts([ARTICLE]) == ["Head & tail\nFirst para bold.\nSecond\nline"]
    assert htmltext.main_texts(["", "plain words", "<p>unclosed <b>x", "a < b <p>c", "<script>never closed"]) == ["", "plain words", "unclosed x", "a < b\nc", ""]


def test_names_and_forms_around_an_article_hide_nothing():
    article = '<article><div class="article-header"><h1>Title</h1></div><div class="header">By me</div><p>Text</p><div class="comments">Nice</div></article>'
    for wrapper in ('div class="content with-sidebar"', 'div class="search-page"', 'div class="nav-open"', 'form action="/x"'):
        assert htmltext.main_texts([f"<body><p>before</p><{wrapper}>{article}</{wrapper.split()[0]}></body>"]) == ["Title\nBy me\nText"]
    assert htmltext.main_texts(["<body><form><div>Whole page</div><footer>f</footer></form></body>"]) == ["Whole page"]
    assert htmltext.main_texts(["<nav><article>menu</article></nav><p>text</p>", f"<div class=related><article>Other</article></div>{article}"]) == ["text", "Title\nBy me\nText"]


BAR = "one two three four five six seven eight nine"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(500)]
    return [" ".join(rng.choice(words, 40)) for _ in range(n)]


def test_repeated_runs_are_boilerplate_without_markup():
    texts = prose(1, 6)
    pages = [f"<div>{BAR}</div><div>{t}</div><div>{BAR} end</div>" for t in texts]
    assert htmltext.main_texts([*pages, pages[0]]) == [*texts, texts[0]]  # a copy of a page repeats nothing
    inside = [f"<p>{BAR} {t}</p>" for t in texts]
    assert htmltext.main_texts(inside) == texts  # the run goes, the rest of its block stays
    assert htmltext.main_texts(pages[:2]) == [f"{BAR}\n{t}\n{BAR} end" for t in texts[:2]]  # two pages are no evidence
    menus = [f"<div>{' '.join(m.split()[:9])}</div><div>{texts[0]}</div>" for m in prose(2, 5)]
    assert all(texts[0] in t for t in htmltext.main_texts(menus))  # one article under five menus isn't five pages
    many = prose(3, 40)
    quoted = [f"<div>{t}</div>" + (f"<div>{BAR}</div>" if k < 3 else "") for k, t in enumerate(many)]
    assert all(BAR in t for t in htmltext.main_texts(quoted)[:3])  # a small share of the pages


def test_articles_keep_quotes_and_lose_what_most_repeat():
    texts = prose(4, 12)
    quoted = [f"<article><p>{t}</p>" + (f"<p>{BAR}</p>" if k < 5 else "") + "</article>" for k, t in enumerate(texts)]
    assert htmltext.main_texts(quoted) == [t + (f"\n{BAR}" if k < 5 else "") for k, t in enumerate(texts)]
    letters = [f"<article><p>{t}</p><p>{BAR}</p></article>" for t in texts]
    assert htmltext.main_texts(letters) == texts
    assert htmltext.main_texts(letters[:9]) == [f"{t}\n{BAR}" for t in texts[:9]]
    ads = [f"<article><p>{t}</p>{f'<p>{BAR}</p>' if k == 0 else ''}</article><div class=ad>{BAR}</div>" for k, t in enumerate(texts)]
    assert htmltext.main_texts(ads)[0] == f"{texts[0]}\n{BAR}"  # adverts are no evidence against an article's own words


def test_suffix_ranks_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        streams = [list(rng.choice(list("abc"), rng.integers(0, 30))) for _ in range(rng.integers(1, 7))]
        owner, counted = rng.integers(0, 3, len(streams)), rng.random(len(streams)) < 0.7
        runs = [list(rng.choice(list("abcd"), 4)) for _ in range(5)]
        array = htmltext.SuffixArray(streams, runs, 4)
        holders = lambda run: {int(owner[k]) for k, s in enumerate(streams) if counted[k] and any(s[j : j + 4] == run for j in range(len(s) - 3))}  # noqa: B023, E731
        spread = array.spread(owner, counted)
        assert spread[array.of_runs].tolist() == [len(holders(r)) for r in runs]
        bad = spread >= 2
        for s, cover in zip(streams, array.covered(bad)):
            want = [False] * len(s)
            for k in range(len(s) - 3):
                if len(holders(s[k : k + 4])) >= 2:
                    want[k : k + 4] = [True] * 4
            assert cover.tolist() == want


def unmarked(page):
    """The page without the markup that tells its parts."""
    import re

    return re.sub(r"(</?)(?:article|nav|footer)\b", r"\1div", page or "").replace('class="ad"', "")


def plain_class(kinds, texts):
    """The longest shown blocks that make up four fifths of the shown text."""
    shown = sorted((t for c, t in zip(kinds, texts) if c != "-"), key=lambda t: (-len(t), t))
    out = []
    while sum(map(len, out)) < 0.8 * sum(map(len, shown)):
        out.append(shown[len(out)])
    return tuple(out)


def plain_extract(rows, order=None):
    """Texts by position: the rules on sets of token runs, host by host; ``order`` tells which page counts for its class."""
    import re

    order = order or (lambda r, k: k)
    hosts = {}
    for k, (_, url, page) in enumerate(rows):
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
        hosts.setdefault(m[1].lower() if m else "", []).append(k)
    out = {}
    for members in hosts.values():
        cut = {k: htmltext.page_blocks(rows[k][2] or "") for k in members}
        classes = {k: plain_class(*cut[k]) for k in members}
        speaks = {k: not any(classes[j] == classes[k] and order(rows[j], j) < order(rows[k], k) for j in members) for k in members}
        seen, inside = {}, {}
        stream = lambda k, own: [w for c, t in zip(*cut[k]) if (c == "a") == own for w in t.split()]  # noqa: B023, E731
        for k in filter(speaks.get, members):
            for own in (True, False):
                s = stream(k, own)
                for i in range(len(s) - 5):
                    run = tuple(s[i : i + 6])
                    seen.setdefault(run, set()).add(classes[k])
                    if own:
                        inside.setdefault(run, set()).add(classes[k])
        n = len(set(classes.values()))
        bad = {False: {r for r, x in seen.items() if len(x) >= 3 and len(x) * 10 >= n}, True: {r for r, x in inside.items() if len(x) >= 10 and len(x) * 2 >= n}}
        for k in members:
            cover = {}
            for own in (True, False):
                s = stream(k, own)
                c = cover[own] = [False] * len(s)
                for i in range(len(s) - 5):
                    if tuple(s[i : i + 6]) in bad[own]:
                        c[i : i + 6] = [True] * 6
            kept, at = [], {True: 0, False: 0}
            for kind, t in zip(*cut[k]):
                own, words = kind == "a", t.split()
                gone = cover[own][at[own] : at[own] + len(words)]
                at[own] += len(words)
                if kind != "-" and not all(gone):
                    kept.append(t if own else " ".join(w for w, g in zip(words, gone) if not g))
            out[k] = "\n".join(kept)
    return [out[k] for k in range(len(rows))]


def row_order(spark, rows):
    """The hash of a row, by which the operator picks the page that counts."""
    from pyspark.sql import functions as F

    got = {(r.page_id, r.url, r.html): r.row for r in frame(spark, rows).select("page_id", "url", "html", F.xxhash64("page_id", "url", F.coalesce("html", F.lit(""))).alias("row")).collect()}
    return lambda r, k: (got[r[:3]], k)


NOTICE = " ".join(f"notice{k}" for k in range(126))


def test_a_notice_longer_than_the_pages_own_blocks_goes(spark):
    """The notice is each page's longest block, and the pages count as different all the same."""
    texts = prose(6, 120)
    pages = [f"<div>{NOTICE}</div>" + "".join(f"<div>{t}</div>" for t in texts[3 * k : 3 * k + 3]) for k in range(40)]
    want = ["\n".join(texts[3 * k : 3 * k + 3]) for k in range(40)]
    assert htmltext.main_texts(pages) == want
    rows = [(k, "http://n.example/", p) for k, p in enumerate(pages)]
    assert [r.text for r in htmltext.extract(frame(spark, rows), 10_000, 8).orderBy("page_id").collect()] == want


def test_copies_of_one_page_above_a_shards_size(spark):
    """Hundreds of copies of a page count once, keep their text, and are dealt by row."""
    texts = prose(7, 60)
    rows = [(k, "http://c.example/", f"<div>{BAR}</div><div>{texts[0]}</div><div>{texts[1]}</div>") for k in range(400)]
    rows += [(1000 + k, "http://c.example/", f"<div>{BAR}</div><div>{t}</div>") for k, t in enumerate(texts[2:])]
    got = {r.page_id: r.text for r in htmltext.extract(frame(spark, rows), 4_000, 8).collect()}
    assert {got[k] for k in range(400)} == {f"{texts[0]}\n{texts[1]}"}
    assert [got[1000 + k] for k in range(58)] == texts[2:]


def test_candidates_grow_with_the_host():
    """A shard of pages without repeated text names nothing; of those that repeat, no more than ten of its pages hold."""
    for n in (40, 64, 128):
        pages = [("s", [t]) for t in prose(8, n)]
        assert htmltext.Pages(pages, [True] * n).candidates() == []
        barred = [("ss", [f"{BAR} x{k} y{k}", t]) for k, (_, [t]) in enumerate(pages)]
        assert len(htmltext.Pages(barred, [True] * n).candidates()) == 4  # of the nine words


def test_extract_equals_the_plain_version_however_hosts_are_split(spark, sf_dir):
    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").collect()]
    texts = prose(5, 30)
    made = [(100_000 + k, "http://made.example/", f"<article><p>{t}</p><p>{BAR}</p></article>") for k, t in enumerate(texts)]
    bare = [(200_000 + i, u, unmarked(h)) for i, u, h in given]
    off = [(i, "\n".join(t for c, t in zip(*htmltext.page_blocks(h or "")) if c != "-")) for i, _, h in (*given, *bare, *made)]
    for rows in ([*given, *made], bare):
        want = sorted(zip((r[0] for r in rows), plain_extract(rows, row_order(spark, rows))))
        for sizes in ((htmltext.SHARD_BYTES, htmltext.SHARD_PAGES), (20_000, 8)):
            assert sorted((r.page_id, r.text) for r in htmltext.extract(frame(spark, rows), *sizes).collect()) == want
    changed = [i for (i, text), (j, without) in zip(sorted(want), sorted(x for x in off if 200_000 <= x[0])) if text != without]
    assert len(changed) > 30  # given pages whose text the suffix array changes where markup tells nothing


def test_extract_edge_rows(spark):
    rows = [(1, "http://h.example/1", ARTICLE), (2, None, None), (3, "http://h.example/2", ""), (1, "http://h.example/1", ARTICLE), (None, "x", "<p>t</p>"), (9, "u", BIG)]
    got = sorted(((r.page_id, r.url, r.n_chars) for r in htmltext.extract(frame(spark, rows)).collect()), key=str)
    n = len("Head & tail\nFirst para bold.\nSecond\nline")
    assert got == sorted([(1, "http://h.example/1", n), (1, "http://h.example/1", n), (2, None, 0), (3, "http://h.example/2", 0), (None, "x", 1), (9, "u", len(("long text " * 20000).strip()))], key=str)
    assert htmltext.extract(frame(spark, [])).count() == 0
