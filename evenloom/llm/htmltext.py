"""Main text of web pages: page structure and a suffix array over each host's pages.

A page is cut into blocks with the kind of markup around them. The token streams of a host's pages are concatenated
and a suffix array, sorted to a depth of ``MIN_TOKENS`` tokens, finds the substrings of at least that length and the
number of different pages that hold them; longer substrings are chains of overlapping ones. Pages that share the blocks
which make up ``SAME`` of their shown text, longest first, are one page in these counts, so that copies repeat nothing,
however long a notice they carry: the page with the smallest hash of its row counts for them all.

- Where no markup tells a page's article, a run of tokens on at least ``OPEN`` pages is boilerplate and is cut from its
  block, and the unique runs stay.
- Where a page marks its article (article, main), its blocks stay, also passages that other articles quote, but for a
  block that repeats inside the articles of at least ``INSIDE`` pages: letter sign-ups and the like.
- Menus, footers, adverts and the like never count; where a form or an element with a telling name holds all of a
  page's article, or the whole of a page without one, it hides nothing.

Both limits are a least number of pages and a least share of the host's. A host of any size is handled whole: its pages
are dealt by row to shards of ``SHARD_BYTES``, and of ``SHARD_PAGES`` at least. Each shard's suffix array names the runs that
reach the share among the pages that count there (a run that reaches it in the host does so in a shard), all shards count
those runs, and the sums decide. A shard so names as many runs as ten of its pages hold at most, and not every one of
a page as a shard of few pages would: what the shards tell each other grows with the host. Of hosts that have under
``DIRECT`` such pages a shard, as most of theirs are copies, each shard counts all runs of the few at once. The result doesn't
depend on the shards.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ready, strings, whole

MIN_TOKENS = 6
#: Least number of a host's different pages, and the least share of them (one in so many).
OPEN, INSIDE = (3, 10), (10, 2)
#: The share of a page's shown text that tells pages apart.
SAME = 0.8
#: A host of more html is dealt to shards of about so many bytes, but so many pages; at most MOST_SPLIT hosts are.
SHARD_BYTES, SHARD_PAGES, DIRECT, MOST_SPLIT = 1 << 18, 64, 16, 1_000_000
PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "math", "select", "xmp", "noembed", "noframes", "audio", "video"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ASIDE_TAGS = frozenset(("nav", "footer", "aside", "form", "button", "menu", "dialog", "head"))
ASIDE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"))
ASIDE_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar sidebar breadcrumb breadcrumbs header masthead footer comment comments reply replies disqus cookie cookies consent gdpr notice notices newsletter subscribe subscription signup share sharing social related recommended widget popup modal overlay login search toolbar copyright pagination pager skip".split())
TITLE_WORDS = frozenset(("header", "banner", "masthead"))
WHOLE_PAGE = frozenset(("html", "body", "article", "main"))


SHOWN, WRAPPED, HIDDEN = range(3)


def names_aside(name: str, in_main: bool) -> bool:
    """Whether a class or id is an aside's or begins with an aside's word; headers inside an article are its own."""
    word = re.split(r"[^a-z]+", name, maxsplit=1)[0]
    return word in ASIDE_WORDS and not (in_main and word in TITLE_WORDS)


def aside(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element holds something other than the page's own text.

    Forms and names are weak signs, as both also stand around whole pages: outside an article they give WRAPPED only.
    """
    if tag in ASIDE_TAGS and tag != "form" or tag == "header" and not in_main:
        return HIDDEN
    weak = HIDDEN if in_main else WRAPPED
    found = weak if tag == "form" else SHOWN
    if not attributes or tag in WHOLE_PAGE:
        return found
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and any(names_aside(x, in_main) for x in value.split()):
            found = max(found, weak)
        if name == "role" and value in ASIDE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return HIDDEN
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HIDDEN
    return found


def blocks(page: str) -> list[tuple[str, bool, int]]:
    """(text, inside an article or main element, SHOWN, WRAPPED or HIDDEN) of each block in page order."""
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, main, aside, both with what is around
    parts: list[str] = []
    main, off = False, SHOWN
    at, lowered = 0, None

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, main, off))

    while (m := PIECE.search(page, at)) is not None:
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if any(x[0] == tag for x in stack):
                if tag in BLOCK:
                    end_block()
                while stack.pop()[0] != tag:
                    pass
                main, off = stack[-1][1:] if stack else (False, SHOWN)
            elif tag in BLOCK:
                end_block()
            continue
        if tag in BLOCK:
            end_block()
        if tag in RAW:
            if lowered is None:
                lowered = page.lower()
                if len(lowered) != len(page):  # a letter whose lower case is longer
                    lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            close = lowered.find(f"</{tag}", at)
            stop = lowered.find(">", close) if close >= 0 else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        if tag in VOID or (m[3] or m[6] or "").endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end by the next one
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    main, off = stack[-1][1:] if stack else (False, SHOWN)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "blockquote"):
                    break
        main, off = main or tag in ("article", "main"), max(off, aside(tag, m[3] or m[6] or "", main))
        stack.append((tag, main, off))
    parts.append(page[at:])
    end_block()
    return out


ARTICLE, SHOWN_BLOCK, ASIDE_BLOCK = "a", "s", "-"


def page_blocks(page: str) -> tuple[str, list[str]]:
    """The kind of each block, and the blocks' texts."""
    cut = blocks(page)
    # what weak signs wrap counts only where nothing else does
    marked = any(main and off < HIDDEN for _, main, off in cut)
    limit = min((off for _, main, off in cut if main or not marked), default=SHOWN)
    shown = [off <= limit < HIDDEN and (main or not marked) for _, main, off in cut]
    return "".join((ARTICLE if marked else SHOWN_BLOCK) if x else ASIDE_BLOCK for x in shown), [text for text, _, _ in cut]


def page_class(kinds: str, texts: list[str]) -> int:
    """A number that pages share if the same blocks make up ``SAME`` of their shown text, longest first; pages without any share one."""
    shown = sorted((t for k, t in zip(kinds, texts) if k != ASIDE_BLOCK), key=lambda t: (-len(t), t))
    need, number = SAME * sum(map(len, shown)), xxhash.xxh64()
    for t in shown:
        if need <= 0:
            break
        need -= len(t)
        number.update(f"{t}\n".encode("utf-8", "surrogatepass"))
    return number.intdigest() >> 1


class SuffixArray:
    """Suffixes of token streams, sorted by their first ``depth`` tokens; equal ones share a rank. ``runs`` of ``depth``
    tokens are streams of nobody, so that their ranks can be looked up."""

    def __init__(self, streams: list[list[str]], runs: list[list[str]], depth: int = MIN_TOKENS):
        number: dict[str, int] = {}
        parts = [np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in [*streams, *runs]]
        self.depth, self.lengths = depth, np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(self.lengths + 1) - 1
        self.stream = np.repeat(np.arange(len(parts)), self.lengths + 1)
        # the streams one after another, each followed by a separator of its own
        rank = np.concatenate([np.append(p, len(number) + k) for k, p in enumerate(parts)]) if parts else np.zeros(0, np.int64)
        reach = 1
        while reach < depth:  # suffixes by their first 2, 4, ... tokens
            step = min(reach, depth - reach)
            after = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])[: len(rank)]
            _, rank = np.unique(rank * (len(rank) + len(number) + 2) + after + 1, return_inverse=True)
            reach += step
        self.rank, self.ranks = rank, int(rank.max(initial=-1)) + 1
        at = np.arange(len(rank))
        self.full = at + depth <= self.ends[self.stream] if len(rank) else np.zeros(0, bool)
        self.of_runs = rank[self.ends[len(streams) :] - depth] if runs else np.zeros(0, np.int64)
        self.n_streams = len(streams)

    def spread(self, owner: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """For each rank the number of different owners of the counted streams that hold it."""
        at = self.full & (self.stream < self.n_streams)
        at[at] = counted[self.stream[at]]
        if not at.any():
            return np.zeros(self.ranks, np.int64)
        k = int(owner.max()) + 1
        return np.bincount(np.unique(self.rank[at] * k + owner[self.stream[at]]) // k, minlength=self.ranks)

    def covered(self, bad: np.ndarray) -> list[np.ndarray]:
        """For each stream which tokens lie in a substring with a bad rank."""
        starts = np.flatnonzero(bad[self.rank] & self.full) if len(self.rank) else np.zeros(0, np.int64)
        cover = np.zeros(len(self.rank) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + self.depth, -1)
        found = np.cumsum(cover[:-1]) > 0
        return [found[e - n : e] for e, n in zip(self.ends[: self.n_streams], self.lengths)]


class Pages:
    """Pages of a host, or of one shard of it, with their suffix array; ``counted`` tells which of them count."""

    def __init__(self, pages: list[tuple[str, list[str]]], counted: list[bool] | None, runs: list[str] = ()):  # type: ignore[assignment]
        self.pages = pages
        self.words = [[t.split(" ") for t in texts] for _, texts in pages]
        # two streams a page: the marked article and all else
        streams = self.streams = [[w for k, block in zip(kinds, words) if (k == ARTICLE) == inside for w in block] for (kinds, _), words in zip(pages, self.words) for inside in (True, False)]
        self.array = SuffixArray(streams, [r.split(" ") for r in runs])
        if counted is None:  # nothing is to be counted here
            return
        self.n = sum(counted)
        owner, marked, counts = np.repeat(np.arange(len(pages)), 2), np.arange(len(streams)) % 2 == 0, np.repeat(np.array(counted, bool), 2)
        self.everywhere = self.array.spread(owner, counts)
        self.inside = self.array.spread(owner, marked & counts)

    def candidates(self, share: int = OPEN[1]) -> list[str]:
        """The runs on one in ``share`` of these pages that count at least; 0 for all runs on such a page."""
        a = self.array
        first = np.full(a.ranks, -1)
        at = np.flatnonzero(a.full & (a.stream < a.n_streams))
        first[a.rank[at][::-1]] = at[::-1]
        flat = [w for s in self.streams for w in (*s, "")]
        return [" ".join(flat[p : p + a.depth]) for p in first[(first >= 0) & (self.everywhere > 0) & ((self.everywhere * share >= self.n) | (share == 0))]]

    def texts(self, bad: np.ndarray, bad_inside: np.ndarray) -> list[str]:
        """The pages' texts, given the ranks that are boilerplate outside and inside of articles."""
        cover_open, cover_inside = self.array.covered(bad), self.array.covered(bad_inside)
        out = []
        for p, ((kinds, texts), words) in enumerate(zip(self.pages, self.words)):
            kept, at, cover = [], {True: 0, False: 0}, {True: cover_inside[2 * p], False: cover_open[2 * p + 1]}
            for kind, text, own in zip(kinds, texts, words):
                inside = kind == ARTICLE
                gone = cover[inside][at[inside] : at[inside] + len(own)]
                at[inside] += len(own)
                if inside and not gone.all():
                    kept.append(text)
                elif kind == SHOWN_BLOCK and not gone.all():
                    kept.append(" ".join(w for w, g in zip(own, gone) if not g) if gone.any() else text)
            out.append("\n".join(kept))
        return out


def enough(pages: np.ndarray, n: int, least: tuple[int, int]) -> np.ndarray:
    return (pages >= least[0]) & (pages * least[1] >= n)


def host_texts(pages: Pages) -> list[str]:
    """The texts of all pages of one host."""
    return pages.texts(enough(pages.everywhere, pages.n, OPEN), enough(pages.inside, pages.n, INSIDE))


def main_texts(pages: list[str]) -> list[str]:
    """The texts of all pages of one host, from their html."""
    cut = [page_blocks(p) for p in pages]
    return host_texts(Pages(cut, firsts([page_class(*p) for p in cut], list(range(len(cut))))))


def firsts(classes: list[int], order: list) -> list[bool]:
    """Which pages are the first of their class."""
    out, seen = [False] * len(classes), set()
    for k in sorted(range(len(classes)), key=order.__getitem__):
        if classes[k] not in seen:
            seen.add(classes[k])
            out[k] = True
    return out


PARSED = "page_id long, url string, host string, shards int, shard long, row long, class long, body binary"
FOUND = "host string, run string"
COUNTED = "host string, run string, pages long, inside long"


def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, row, html) -> (host, class, row)."""
    for batch in batches:
        number = [page_class(*page_blocks(page)) for page in strings(batch.column(2), 64)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int64()), batch.column(1)], ["host", "class", "row"])


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, host, shards, shard, row, html) with the html cut in blocks, compressed for the way."""
    for batch in batches:
        out = []
        for page in strings(batch.column(6), 64):
            kinds, texts = page_blocks(page)
            raw = "\n".join([kinds, *texts]).encode("utf-8", "surrogatepass")
            out.append((page_class(kinds, texts), len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)))
        cols = list(zip(*out)) if out else [()] * 2
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary())))], [x.split()[0] for x in PARSED.split(", ")])


def opened(table: pa.Table) -> list[tuple[str, list[str]]]:
    pages = []
    for body in table.column("body").to_pylist():
        kinds, *texts = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n")
        pages.append((kinds, texts))
    return pages


def _arrow(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in spec.split(", "))])


def _counting(table: pa.Table, beside: pa.Table) -> pa.Table:
    """The shard's pages that count, one for each row number beside them."""
    wanted, seen, at = set(beside.column("row").drop_null().to_pylist()), set(), []
    for k, row in enumerate(table.column("row").to_pylist()):
        if row in wanted and row not in seen:
            seen.add(row)
            at.append(k)
    return table.take(pa.array(at, pa.int64()))


def propose(table: pa.Table, firsts_here: pa.Table) -> pa.Table:
    """The candidates of a shard of a split host."""
    pages = _counting(table, firsts_here) if len(table) and len(firsts_here) else table.slice(0, 0)
    if not len(pages) or firsts_here.column("direct")[0].as_py():
        return _arrow(FOUND).empty_table()
    runs = Pages(opened(pages), [True] * len(pages)).candidates()
    return pa.table({"host": [table.column("host")[0].as_py()] * len(runs), "run": runs}, _arrow(FOUND))


def count(table: pa.Table, beside: pa.Table) -> pa.Table:
    """A shard's counting pages with each of the host's candidates, or with each run at all."""
    pages = _counting(table, beside) if len(table) and len(beside) else table.slice(0, 0)
    if not len(pages):
        return _arrow(COUNTED).empty_table()
    every = opened(pages)
    runs = beside.column("run").drop_null().to_pylist()
    if any(beside.column("direct").drop_null().to_pylist()):
        runs = Pages(every, [True] * len(every)).candidates(0)
    if not runs:
        return _arrow(COUNTED).empty_table()
    found = Pages(every, [True] * len(every), runs)
    at = found.array.of_runs
    host = table.column("host")[0].as_py()
    return pa.table({"host": [host] * len(runs), "run": runs, "pages": found.everywhere[at], "inside": found.inside[at]}, _arrow(COUNTED))


RESULT = "page_id long, url string, text string, n_chars long"


def result(table: pa.Table, texts: list[str]) -> pa.Table:
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, _arrow(RESULT))


def decide(table: pa.Table, judged: pa.Table) -> pa.Table:
    """The texts of a shard's pages by the host's boilerplate, or of a host's that isn't split by its own."""
    if not len(table):
        return _arrow(RESULT).empty_table()
    if table.column("shards")[0].as_py() == 1:
        order = list(zip(table.column("row").to_pylist(), table.column("body").to_pylist()))
        return result(table, host_texts(Pages(opened(table), firsts(table.column("class").to_pylist(), order))))
    pages = Pages(opened(table), None, judged.column("run").to_pylist())
    ranks, bad = pages.array.of_runs, {}
    for c in ("open", "inside"):
        bad[c] = np.zeros(pages.array.ranks, bool)
        bad[c][ranks] = judged.column(c).to_numpy(zero_copy_only=False).astype(bool)
    return result(table, pages.texts(bad["open"], bad["inside"]))


def extract(pages: DataFrame, shard_bytes: int = SHARD_BYTES, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null html counts as empty and has an empty text.

    Pages without a host in their url are one host's. Equal page_ids are separate pages. An empty table gives none.
    ``shard_bytes`` and ``shard_pages`` only deal the work. Pages are parsed twice, for what tells them apart and for their
    text, and travel once.
    """
    spark = ready(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), whole("html").alias("html"))
    rows = rows.withColumn("row", F.xxhash64("page_id", "url", "html"))
    sizes = durable(rows.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("n")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    shard = max(shard_bytes, -(-total // MOST_SPLIT))
    number = F.least(F.ceil(F.col("bytes") / shard), F.floor(F.col("n") / shard_pages)).cast("int")
    # fewer than MOST_SPLIT hosts, as each has over total / MOST_SPLIT bytes
    large = F.broadcast(sizes.where(F.col("bytes") > shard).select("host", number.alias("shards")).where("shards > 1"))
    told_apart = rows.join(large.select("host"), "host", "left_semi").select("host", "row", "html").mapInArrow(classify, "host string, class long, row long")
    speakers = durable(told_apart.groupBy("host", "class").agg(F.min("row").alias("row")))
    split = F.broadcast(durable(speakers.groupBy("host").agg(F.count("*").alias("n")).join(large, "host").withColumn("direct", F.col("n") < DIRECT * F.col("shards"))))

    known = rows.join(large, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    known = known.select("page_id", "url", "host", "shards", F.pmod("row", F.col("shards").cast("long")).alias("shard"), "row", "html")
    key = ["host", "shard"]
    dealt = known.mapInArrow(parse, PARSED).groupBy(*key)
    counting = speakers.join(split, "host").select("host", F.pmod("row", F.col("shards").cast("long")).alias("shard"), "row", "direct")
    everywhere = lambda df: df.join(split.select("host", "shards"), "host").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1))).drop("shards")
    found = dealt.cogroup(counting.groupBy(*key)).applyInArrow(propose, FOUND).distinct()
    beside = counting.withColumn("run", F.lit(None).cast("string")).unionByName(everywhere(found), allowMissingColumns=True)
    counted = dealt.cogroup(beside.groupBy(*key)).applyInArrow(count, COUNTED)
    sums = counted.groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.sum("inside").alias("inside")).join(split.select("host", "n"), "host")
    least = lambda c, limit: (F.col(c) >= limit[0]) & (F.col(c) * limit[1] >= F.col("n"))
    judged = sums.select("host", "run", least("pages", OPEN).alias("open"), least("inside", INSIDE).alias("inside")).where("open or inside")
    return dealt.cogroup(everywhere(judged).groupBy(*key)).applyInArrow(decide, RESULT)
