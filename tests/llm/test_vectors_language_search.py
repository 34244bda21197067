"""Vector codes, language identification and ranked search against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evenloom.llm import language, search, vectors


# ---- vector codes


def plain_codes(rows, rounds=6):
    """rows: (vec_id, label, list of floats), the definition with Python integers -> (id, code, error, label_error, digest)."""
    kept = [(i, y, [math.floor(4096 * x) for x in v]) for i, y, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][2]) // 8
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = [v for i, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, [x / 4096 for x in r[2]]))[:16]]
    books = [[cut(v, p) for v in seeds] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            groups = defaultdict(list)
            for _, _, v in kept:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, y, v in kept:
        best = [near(cut(v, p), books[p]) for p in range(8)]
        out.append((i, y, bytes(e for _, e in best).hex(), sum(d for d, _ in best)))
    sums = Counter()
    for _, y, _, d in out:
        sums[y] += d
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, code, d, sums[y], digest) for i, y, code, d in out]


VECTORS = "vec_id long, embedding array<float>, label int, code int, part int, label_key string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, "x") for i, y, v in rows], VECTORS)


def vector_rows(n, dim, rng, spread=0.3):
    middle = rng.normal(0, 1, (6, dim))
    return [(k, int(k % 5) if k % 7 else None, [float(np.float32(x)) for x in middle[k % 6] + rng.normal(0, spread, dim)]) for k in range(n)]


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("n, dim, spread", [(700, 16, 0.3), (400, 64, 0.02), (12, 8, 0.5)])
def test_vector_codes_equal_the_definition(spark, monkeypatch, n, dim, spread):
    rows = vector_rows(n, dim, np.random.default_rng(n), spread)
    rows += [(10**6, 1, None), (10**6 + 1, 1, [None] * dim), (10**6 + 2, 1, [float("nan")] * dim), (10**6 + 3, 1, [float("inf")] + [0.0] * (dim - 1))]
    rows += [rows[3], (rows[5][0], 2, rows[9][2]), (-7, 3, rows[1][2]), (10**7, 3, rows[1][2])]
    got = [tuple(r) for r in vectors.vector_codes(vector_frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(plain_codes(rows), key=key)


def test_vector_codes_of_many_small_chunks_and_null_ids(spark):
    rng = np.random.default_rng(4)
    rows = vector_rows(300, 16, rng, 0.05) + [(None, None, [0.25] * 16), (None, 1, [0.25] * 16)] + [(5000 + k, 2, [0.5] * 16) for k in range(200)]
    df = vector_frame(spark, rows).repartition(3)
    before = vectors.CHUNK_INTS
    try:
        vectors.CHUNK_INTS = 1
        small_chunks = vectors.vector_codes(df).collect()
    finally:
        vectors.CHUNK_INTS = before
    assert sorted(map(tuple, small_chunks), key=key) == sorted(map(tuple, vectors.vector_codes(df).collect()), key=key) == sorted(plain_codes(rows), key=key)


def test_vector_codes_odd_lengths_and_empty_tables(spark):
    rows = vector_rows(20, 16, np.random.default_rng(1))
    odd = [(100, 1, []), (101, 1, [1.0] * 8), (102, 1, [1.0] * 15)]
    got = vectors.vector_codes(vector_frame(spark, rows + odd)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_codes(rows), key=key)
    assert vectors.vector_codes(vector_frame(spark, [(1, 1, None)])).collect() == []
    with pytest.raises(ValueError):
        vectors.integers(np.full((1, 16), 1e9))


def test_shortlists_keep_every_nearest_entry_and_drop_most():
    rng = np.random.default_rng(3)
    points = np.sort(rng.integers(-2000, 2000, (1024, 2)), 0).repeat(4, 1)
    points = points[np.argsort(vectors.hilbert_keys(points), kind="stable")]
    entries = points[rng.integers(0, 1024, 16)]
    starts = np.arange(0, 1024, 32)
    short = vectors.shortlists(np.minimum.reduceat(points, starts, 0), np.maximum.reduceat(points, starts, 0), entries)
    best = ((points[:, None] - entries) ** 2).sum(2).argmin(1)
    assert short[np.repeat(np.arange(32), 32), best].all()
    assert short.mean() < 0.5


def test_hilbert_keys_are_a_curve():
    """On a full grid every key occurs once and neighbours in the order are neighbours on the grid."""
    side = np.array(np.meshgrid(*[np.arange(16)] * 2)).reshape(2, -1).T
    keys = vectors.hilbert_keys(side * ((1 << 16) - 1) // 15)
    order = side[np.argsort(keys)]
    assert len(set(keys.tolist())) == 256
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# ---- language


DOCS = "doc_id long, text string, lang string, source string, n_chars long, held_out string, id string, score int, gram int"


def doc_frame(spark, rows):
    return spark.createDataFrame([(i, t, y, "s", 0, "x", "y", 1, 2) for i, t, y in rows], DOCS)


SAMPLES = {
    "en": "the other thing with this was that they would have gone there without the weather changing",
    "de": "der andere schöne garten wird heute nicht zwischen den häusern gebaut und auch nicht später",
    "fr": "les autres élèves étaient très contents de leur journée à la plage avec beaucoup de soleil",
    "es": "los otros niños estaban muy contentos con la mañana y después volvieron a casa por el camino",
}


def sentences(n, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        lang = list(SAMPLES)[k % 4]
        out.append((k, " ".join(rng.choice(SAMPLES[lang].split(), 12)), lang))
    return out


def plain_grams(text):
    """Padded n-grams with letters inside, by strings; what is no letter is a space."""
    padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    out = Counter()
    for n in language.GRAMS:
        for k in range(len(padded) - n + 1):
            g = padded[k : k + n]
            if all(c != " " for c in g[1:-1]) and (n > 2 or g != "  "):
                out[g] += 1
    return out


def hashed(text):
    out = Counter()
    for points, _, _, last in language.slices(iter([text])):
        for _, h in language.grams(points, last):
            out.update(h.tolist())
    return out


@pytest.mark.parametrize("text", ["", " ", "a", "The cat, the Hat!", "é2ß x", "a b c dd eee", "x" * 50, "12 34", "ab  cd\n\nef"])
def test_grams_against_strings(text):
    want = plain_grams(text)
    assert sorted(hashed(text).values()) == sorted(want.values())
    assert len(hashed(text)) == len(want)


def test_slices_of_a_long_text_lose_and_repeat_nothing(monkeypatch):
    text = "the quick brown fox, jumps over: " * 300
    want = hashed(text)
    monkeypatch.setattr(language, "SLICE", 1000)
    assert hashed(text) == want


def test_filters_equal_sets_but_for_corrected_false_positives(spark):
    """The votes are close to the counts that exact sets give, and the predictions are the same."""
    rows = sentences(400)
    filters = language.learned(doc_frame(spark, rows))
    taught = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {y: sum((hashed(t) for t, z in taught if z == y), Counter()) for y in SAMPLES}
    total = {y: sum(c.values()) for y, c in counts.items()}
    best = Counter()
    for y, c in counts.items():
        for g, n in c.items():
            best[g] = max(best[g], n / total[y])
    sets = {y: {g for g, n in c.items() if n >= 2 and n / total[y] >= language.TYPICAL * best[g]} for y, c in counts.items()}
    for _, t, y in sentences(40, 5):
        votes, n = filters.votes([t])
        want = {z: sum(k for g, k in hashed(t).items() if g in sets[z]) for z in SAMPLES}
        got = dict(zip(filters.languages, votes[0]))
        assert n[0] == sum(hashed(t).values())
        assert all(abs(got[z] - want[z]) <= 0.02 * n[0] + 1 for z in SAMPLES)
        assert max(got, key=got.get) == max(want, key=want.get) == y


def test_no_false_negatives_in_filters():
    rng = np.random.default_rng(1)
    cells = np.zeros((1, 1 << 12), np.uint64)
    grams = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    step = grams >> np.uint64(32) | np.uint64(1)
    for j in range(language.HASHES):
        cells[0, ((grams + np.uint64(j) * step) & np.uint64((1 << 12) - 1)).astype(int)] |= np.uint64(2)
    found = language.Filters(["a", "b"], cells).containing(grams)
    assert (found[0] == 2).all()


def test_language_cases(spark):
    rows = sentences(200) + [(1000, None, "en"), (1001, "", None), (1002, "12 !! 34", "fr"), (None, SAMPLES["de"], "fr"), (1003, SAMPLES["fr"] * 5000, None), (1004, "你好", None), (7, "the weather", None), (7, "the weather", None)]
    got = language.language(doc_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert [by[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[None][0].lang_pred == "de" and by[1003][0].lang_pred == "fr"
    assert by[1004][0].lang_pred in SAMPLES and by[1004][0].score == 0
    right = [r.lang_pred == dict((i, y) for i, _, y in sentences(200))[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id != 7]
    assert np.mean(right) > 0.98
    assert language.language(doc_frame(spark, rows).limit(0)).collect() == []
    assert {r.lang_pred for r in language.language(doc_frame(spark, [(1, "words", None)])).collect()} == {"und"}


def test_more_languages_than_a_word_has_bits(spark):
    rows = [(k * 70 + j, " ".join(chr(0x4E00 + j * 40 + (k + x) % 7) * 2 for x in range(20)), f"l{j:02d}") for k in range(8) for j in range(70)]
    got = language.language(doc_frame(spark, rows)).collect()
    want = {i: y for i, _, y in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got)


def test_language_is_right_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 20
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


# ---- search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top=20):
    parsed = [(i, terms_of(t)) for i, t in docs]
    parsed = [(i, ws) for i, ws in parsed if ws]
    n_docs, total = len(parsed), sum(len(ws) for _, ws in parsed)
    df = Counter(w for _, ws in parsed for w in set(ws))
    out = []
    for item, text in items:
        asked, found = Counter(terms_of(text)), []
        for i, ws in parsed:
            tf, m = Counter(ws), 75 + 25 * len(ws) * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w, q in asked.items() if tf[w])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return out


def search_frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], "doc_id long, text string, source string, rank int, score int"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")


def random_texts(n, rng, words=400):
    names = np.array([f"w{k}" if k % 3 else f"É{k}" for k in range(words)])
    p = 1 / np.arange(1, words + 1)
    return [(k, " ".join(rng.choice(names, int(rng.integers(1, 60)), p=p / p.sum()))) for k in range(n)]


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(8)
    docs = random_texts(1500, rng)
    docs += [(2000, None), (2001, ""), (2002, "!?"), (None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (3, "other words w7"), (2003, docs[9][1] * 3000), (2004, "x" * 3_000_000), (2005, docs[3][1])]
    items = [(k, " ".join(t.split()[:12])) for k, t in docs[:60]] + [(100, None), (101, ""), (102, "nowhere found"), (103, docs[3][1] + " " + docs[3][1]), (None, "W1 w2 é3"), (5, "w1"), (5, "w1")]
    got = [tuple(r) for r in search.search(*search_frames(spark, docs, items)).collect()]
    assert sorted(got, key=key) == sorted(plain_search(docs, items), key=key)


def test_search_in_several_blocks_of_items(spark, monkeypatch):
    rng = np.random.default_rng(9)
    docs, items = random_texts(300, rng), random_texts(25, rng)
    monkeypatch.setattr(search, "ITEMS", 7)
    got = [tuple(r) for r in search.search(*search_frames(spark, docs, items)).collect()]
    assert sorted(got) == sorted(plain_search(docs, items))


def test_search_on_empty_tables(spark):
    docs, items = search_frames(spark, [(1, "a b")], [(1, "a")])
    assert [tuple(r) for r in search.search(docs, items).collect()] == plain_search([(1, "a b")], [(1, "a")])
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []


def test_bounds_are_above_scores_and_prune(spark):
    """No vector scores above its bound, and most vectors are never scored."""
    rng = np.random.default_rng(10)
    docs, texts = random_texts(2000, rng), random_texts(20, rng)
    items = search.Items.of(texts)
    frame, _ = search_frames(spark, docs, texts)
    rows = search.projected(frame, items, "doc_id", "text").cache()
    n, total = rows.count(), rows.groupBy().sum("n").first()[0]
    weights = search.Weights.of(search.document_frequencies(rows, len(items.vocabulary)), n, total)
    batch = search.vectors(rows, weights).coalesce(1).sortWithinPartitions("length", ascending=False).toArrow().combine_chunks().to_batches()[0]
    b = search.Bucket(batch, weights)
    scored = 0
    for t, c in zip(items.terms, items.counts):
        dense = np.zeros(len(weights.weight), np.int64)
        dense[t] = c
        exact = b.scores(np.arange(len(b.length)), dense)
        common = weights.common[t]
        square = c.astype(float) ** 2 * weights.weight[t]
        bound = b.bounds(t[~common], c[~common], math.sqrt(square[common].sum()))
        assert (bound >= exact).all()
        assert (math.sqrt(square.sum()) * b.length * search.SLACK >= exact).all()
        scored += (bound >= np.sort(exact)[-20]).sum()
    assert scored < 0.5 * 20 * len(b.length)
