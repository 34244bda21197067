"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
import xxhash

from evenloom.llm import bpe, components, counts, exact, fingerprints, mixing, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fingerprint int, keep_id int, part int, key int, component_id int, score int, topic_x string"
LONG = "alpha beta gamma delta " * 5000


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}", 0, "x", 1, 2, 3, 4, 5, 6, "y") for i, t in rows], SCHEMA)


ROWS = [(5, "The  cat\tsat on the mat today"), (3, "The cat sat on the mat today"), (9, "THE CAT sat on the mat today"), (1, None), (2, ""), (4, " \n "), (7, LONG), (8, LONG), (6, "one"), (6, "one"), (10, "É ß \U0001f600 x"), (11, "É ß x"), (None, "one"), (12, "The cat sat on the mat today again")]


def brute_print(text):
    words = bytes(text.encode()).lower().split() if text else []
    words = simhash.WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    """prints: list of (id, fingerprint) -> smallest id reachable for each position."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if bin(prints[a][1] ^ prints[b][1]).count("1") <= bits:
            parent[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(prints):
        best[find(k)] = min(best.get(find(k), i), i)
    return [best[find(k)] for k in range(len(prints))]


def test_simhash_against_brute_force(spark):
    rows = [r for r in ROWS if r[0] is not None]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(frame(spark, rows)).collect())
    prints = [(i, brute_print(t)) for i, t in rows]
    assert got == sorted((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints, 3)))


def test_simhash_links_within_dense_buckets(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 6, dtype=np.uint64)
    prints = [int(base[rng.integers(6)]) for _ in range(500)]
    for k in range(500):
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            prints[k] ^= 1 << int(b)
    distinct = sorted(set(prints))
    df = spark.createDataFrame([(k, p - (1 << 64) if p >= 1 << 63 else p) for k, p in enumerate(distinct)], "id long, f0 long")
    for cap in (4096, 8):  # 8: every larger bucket is split in sub-blocks
        links = simhash.near_links(df, 1, simhash.exact_tables(), 3, cap)
        found = {r.node: r.component for r in components.components(links).collect()}
        want = brute_components(list(enumerate(distinct)), 3)
        assert [found.get(k, k) for k in range(len(distinct))] == want
    pairs = sum(bin(a ^ b).count("1") <= 3 for a, b in itertools.combinations(distinct, 2))
    assert simhash.near_links(df, 1, simhash.exact_tables(), 3).count() < max(pairs, 10 * len(distinct)) + 1


def test_pivots_never_discard_a_near_pair():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 64, (200, 1), dtype=np.uint64)
    b = a.copy()
    for k in range(200):
        for bit in rng.choice(64, 3, replace=False):
            b[k] ^= np.uint64(1 << int(bit))
    for p in simhash.pivots(1):
        assert (abs(simhash.distance(a, p) - simhash.distance(b, p)) <= 3).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 200), (201, 202), (202, 201), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[100 + k] == 100 for k in range(40)) and got[200] == 200 and got[202] == 201
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_dedup_keeps_one_of_each_group_and_all_columns(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base[:10]):
        w = t.split()
        w[5] = "changed"
        rows.append((100 + k, " ".join(w)))
    df = frame(spark, rows)
    out = simhash.near_dedup(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == list(range(20))


def test_exact_groups_against_brute_force(spark):
    df = frame(spark, ROWS).repartition(5)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(df, fan_in=2).collect()), key=str)
    import re

    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in ROWS]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    out = exact.exact_dedup(df)
    assert out.columns == df.columns
    first = {}
    for i, t in norm:
        first[t] = min(first.get(t, (True, 0)), (i is None, i or 0))
    assert sorted(((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in out.collect()), key=str) == sorted(((None if no else i, t) for t, (no, i) in first.items()), key=str)


def test_exact_dedup_keeps_unique_texts_of_repeated_ids(spark):
    rows = [(1, "same text"), (2, "same text"), (2, "unique other text"), (None, "same text"), (None, "alone"), (None, "alone"), (5, "twice"), (5, "twice")]
    out = exact.exact_dedup(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "same text"), (2, "unique other text"), (None, "alone"), (5, "twice")], key=str)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


def reference(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=bpe.read_ranks(vocabulary[0]), special_tokens={})


def test_bpe_equals_the_library(spark, vocabulary):
    enc = reference(vocabulary)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded_chars) for r in bpe.encoded(frame(spark, ROWS), *vocabulary).collect()}
    want = set()
    for i, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(t or "")))
    assert got == want


def test_transducer_on_odd_pieces(vocabulary):
    enc, codec = reference(vocabulary), bpe.Codec(*vocabulary)
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 30, 300, 9000):
        for alphabet in ("ab", "aé日🙂", "0123 ", "the ing", "{}\"' \n"):
            t = "".join(rng.choice(list(alphabet), n))
            assert np.frombuffer(codec.encode(t), "<u4").tolist() == enc.encode_ordinary(t)
    small = bpe.Transducer(bpe.read_ranks(vocabulary[0]), max_states=3)  # starts its cache anew all the time
    for w in ("unbelievable", "xqzt", "aaaaaaaaaaaaaaaa"):
        assert small.encode(w.encode()) == enc.encode_ordinary(w)


def test_utf8_stream_at_every_cut():
    for data in ("aé日🙂z".encode(), b"\xff\xe2\x82", b"\xf0\x9f\x99", b"ab\xc3", b"\xed\xa0\x80x", b"\xc3\xc3\xa9"):
        whole = data.decode("utf-8", "replace")
        for a, b in itertools.combinations_with_replacement(range(len(data) + 1), 2):
            assert "".join(bpe.decode_text([data[:a], data[a:b], data[b:]])) == whole


def test_token_counts_against_viterbi(spark, vocabulary):
    scores = counts.rank_scores(bpe.read_ranks(vocabulary[0]))

    def brute(piece):
        data = piece.encode()
        best = [(0.0, 0)] + [None] * len(data)
        for e in range(1, len(data) + 1):
            best[e] = max((best[s][0] + scores[data[s:e]], best[s][1] - 1) for s in range(e) if data[s:e] in scores)
        return -best[-1][1]

    import regex

    split = regex.compile(vocabulary[1]).findall
    rows = [(i, t) for i, t in ROWS if t != LONG]
    got = sorted(((r.doc_id, r.n_tokens) for r in counts.token_counts(frame(spark, rows), *vocabulary).collect()), key=str)
    assert got == sorted(((i, sum(map(brute, split(t or "")))) for i, t in rows), key=str)
    trie = counts.ForwardTrie(scores, max_nodes=5)
    assert [trie.insert(w) for w in ("unbelievable", "unbeliever", "unbelievable")] == [brute("unbelievable"), brute("unbeliever"), brute("unbelievable")]


def test_mixing_meets_its_marginals(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(rng.integers(5, 60)))) for k in range(3000)]
    targets = mixing.Targets({"source": {"s1": 0.5, "s2": 0.3}, "lang": {"en": 0.6}})
    got = mixing.mixed(frame(spark, rows), targets).toPandas()
    assert len(got) == 3000 and got.probability.max() == pytest.approx(1.0)
    share = lambda by: (got.n_tokens * got.probability).groupby(got[by]).sum() / (got.n_tokens * got.probability).sum()
    assert share("source")["s1"] == pytest.approx(0.5, abs=1e-6) and share("source")["s2"] == pytest.approx(0.3, abs=1e-6) and share("lang")["en"] == pytest.approx(0.6, abs=1e-6)
    kept = got[got.kept]
    assert (kept.n_tokens.groupby(kept.source).sum() / kept.n_tokens.sum())["s1"] == pytest.approx(0.5, abs=0.05)
    again = mixing.mixed(frame(spark, rows), targets).toPandas()
    assert set(again[again.kept].doc_id) == set(kept.doc_id)


def plain_mixing(rows, targets, power=mixing.POWER):
    """rows (source, lang, topic, tokens) -> weight of each row, by plain loops over cells."""
    cells = {}
    for *cell, n in rows:
        cells[tuple(cell)] = cells.get(tuple(cell), 0) + n
    cells = {c: n for c, n in cells.items() if n}
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    pools, want = [], []
    for d in range(3):
        levels = {c[d] for c in cells}
        if targets is None:
            pool = {x: x for x in levels}
            share = {x: sum(n for c, n in cells.items() if c[d] == x) ** power for x in levels}
        else:
            named = targets[d]
            pool = {x: x if x in named else "*" for x in levels}
            share = {p: named.get(p, 1 - sum(named.values())) for p in pool.values()}
        total_share = sum(share.values())
        pools.append(pool)
        want.append({p: x / total_share for p, x in share.items()})
    last = float("inf")
    for _ in range(60):  # ends as rake() states
        worst = 0.0
        for d in range(3):
            now = {}
            for c, x in w.items():
                now[pools[d][c[d]]] = now.get(pools[d][c[d]], 0) + x
            worst = max(worst, *(abs(x - want[d][p]) for p, x in now.items()))
            w = {c: x * want[d][pools[d][c[d]]] / now[pools[d][c[d]]] for c, x in w.items()}
        if worst < 1e-6 or worst > 0.99 * last:
            break
        last = worst
    return {c: w[c] * total / n for c, n in cells.items()}


def tokens_by_cell(rows):
    out = {}
    for *cell, n in rows:
        out[tuple(cell)] = out.get(tuple(cell), 0) + n
    return out


def test_mixing_against_plain_raking(spark):
    rng = np.random.default_rng(14)
    rows = [(k, f"s{int(rng.integers(90) ** 1.2) // 2}", ["en", "de", None][int(rng.integers(3))], f"t{int(rng.integers(4))}", " ".join(["w"] * int(rng.integers(0, 30)))) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, text string")
    plain = [(s, l or "unknown", t, len(x.split())) for _, s, l, t, x in rows]
    assert len({r[0] for r in plain}) > 64  # every level has its own marginal
    for targets, named in ((None, None), (mixing.Targets({"source": {"s1": 0.3, "s2": 0.2}, "lang": {"en": 0.5, "none": 0.2}}), ({"s1": 0.3, "s2": 0.2}, {"en": 0.5, "none": 0.2}, {}))):
        got = mixing.mixed(df, targets).collect()
        want = plain_mixing(plain, named)
        top = max(want.values())
        assert len(got) == len(rows)
        for r in got:
            x = want.get((r.source, r.lang, r.topic), 0.0)
            assert r.weight == pytest.approx(x, rel=1e-4, abs=1e-6) and r.probability == pytest.approx(min(1, x / top), rel=1e-4, abs=1e-6)
        cells = spark.createDataFrame([(*c, n) for c, n in tokens_by_cell(plain).items() if n], "source string, lang string, topic string, t long")
        by = mixing.goals(cells, targets)
        one, two = ({(r.source, r.lang, r.topic): r.w for r in mixing.rake(cells, by, few=few).collect()} for few in (0, 10_000))
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-6, abs=1e-9) for k in one)  # in Spark or in the driver
        kept = sum(r.kept for r in got) / len(got)
        assert kept == pytest.approx(np.mean([r.probability for r in got]), abs=0.03)


def test_topics_read_whole_texts(spark):
    rng = np.random.default_rng(15)
    a, b = [f"alpha{chr(97 + k)}" for k in range(20)], [f"beta{chr(97 + k)}" for k in range(20)]
    same = "the same first line of every text"
    rows = [(k, same + "\n" + " ".join(rng.choice(a if k % 2 else b, 40))) for k in range(200)]
    rows.append((1000, same + "\n" + "zeta " * 30000 + "\n" + " ".join(rng.choice(a, 40))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.topic for r in mixing.mixed(df).collect()}
    even, odd = ({got[k] for k in range(p, 200, 2)} for p in (0, 1))
    assert even and odd and not even & odd
    again = {r.doc_id: r.topic for r in mixing.mixed(df.repartition(7)).collect()}
    assert again == got


def test_mixing_edge_rows(spark):
    got = mixing.mixed(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.probability <= 1 for r in got)
    df = frame(spark, ROWS)
    out = mixing.sample(df)
    assert out.columns == df.columns
    kept = sorted((str(r.doc_id), r.n_tokens) for r in got if r.kept)
    assert sorted((str(r.doc_id), len(simhash.WORD.findall((r.text or "").encode()))) for r in out.collect()) == kept


def test_toxicity_learns_only_from_the_other_rows(spark):
    rng = np.random.default_rng(6)
    words = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, " ".join([*rng.choice(words, 30), *(["vileword"] if bad else [])])))
        held = zlib.crc32(str(k).encode()) % 5 == 0
        labels.append((k, int(not bad) if held else int(bad)))  # held-out labels are wrong: learning from them would show
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(400))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= got[k].score <= 1 for k in range(400))
    edge = toxicity.toxicity(frame(spark, ROWS), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(edge) == len(ROWS) and all(r.predicted == 0 for r in edge)


def test_counterfactual_penalty_balances_identity_terms():
    rng = np.random.default_rng(7)
    words = [f"word{k}" for k in range(200)]
    texts, labels = [], []
    for k in range(600):  # toxic sentences mention one group far more often
        bad = k % 3 == 0
        group = "muslims" if rng.random() < (0.8 if bad else 0.1) else "christians"
        texts.append({*rng.choice(words, 12), group, *(["vileword"] if bad and rng.random() < 0.8 else [])})
        labels.append(int(bad))
    rows = [toxicity.features(t) for t in texts]
    groups = {"muslims": ("muslims", "christians"), "christians": ("muslims", "christians")}
    pairs = [(*x, 1) for t in texts for x in toxicity.swaps(t, groups)]
    gap = {}
    for balance in (0.0, 3.0):
        w, b = toxicity.fit(rows, labels, pairs, balance)
        gap[balance] = abs(w[toxicity.features({"muslims"})].sum() - w[toxicity.features({"christians"})].sum())
    assert gap[3.0] < 0.3 * gap[0.0]


def test_swaps_against_whole_copies():
    rng = np.random.default_rng(11)
    words = ["the", "then", "there", "other", "others", "moth", "mother", "father", "fat", "an"]
    group = ("mother", "father", "moth")
    for _ in range(50):
        text = set(rng.choice(words, 5))
        got = [(a.tolist(), b.tolist()) for a, b in toxicity.swaps(text, {t: group for t in group})]
        before, want = set(toxicity.features(text).tolist()), []
        for term in sorted(text & set(group)):
            for other in group:
                if other not in text:
                    after = set(toxicity.features(text - {term} | {other}).tolist())
                    want.append((sorted(before - after), sorted(after - before)))
        assert got == want


def test_given_rows_have_counterfactual_pairs_that_act(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.training_rows(docs, labels)
    groups = toxicity.mentions(rows)
    assert len(groups) >= 5 and all(len(g) >= 2 for g in groups)
    groups_of = {t: g for g in groups for t in g}
    texts = [toxicity.distinct_words(r.text) for r in rows.collect()]
    swaps = [x for t in texts for x in toxicity.swaps(t, groups_of)]
    assert len(swaps) > 1000
    change = {}
    for balance in (0.0, 5.0):
        w, _ = toxicity.train(docs, labels, balance=balance)
        change[balance] = np.mean([(w[a].sum() - w[b].sum()) ** 2 for a, b in swaps])
    assert change[5.0] < 0.5 * change[0.0]


def test_fit_minimises_the_stated_loss():
    rng = np.random.default_rng(12)
    words = [f"k{k:02d}" for k in range(12)]
    texts = [set(rng.choice(words, 4)) for _ in range(80)]
    labels = [int("k00" in t or "k01" in t and rng.random() < 0.7) for t in texts]
    rows = [toxicity.features(t) for t in texts]
    pairs = [(*x, 2) for t in texts[:20] for x in toxicity.swaps(t, {w: ("k01", "k02") for w in ("k01", "k02")})]
    w, b = toxicity.fit(rows, labels, pairs, 2.0, 1e-3, 4000, 1)

    def loss(w, b):
        raw = np.array([w[r].sum() + b for r in rows])
        y = np.array(labels)
        own = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        n = sum(p[2] for p in pairs)
        return (own * np.logaddexp(0, np.where(y > 0, -raw, raw))).sum() + 2.0 * sum(k * (w[a].sum() - w[c].sum()) ** 2 for a, c, k in pairs) / n + 1e-3 * np.abs(w).sum()

    best, used = loss(w, b), np.unique(np.concatenate(rows))
    for _ in range(300):  # no small step from the solution lowers the loss
        step = np.zeros_like(w)
        step[used] = rng.normal(0, 0.01, len(used)) * (rng.random(len(used)) < 0.2)
        assert loss(w + step, b + rng.normal(0, 0.01)) > best - 1e-6


def test_drop_toxic_acts_by_row(spark):
    rng = np.random.default_rng(13)
    words = [f"word{k}" for k in range(300)]
    rows = [(k, " ".join([*rng.choice(words, 20), *(["vileword"] if k % 4 == 0 else [])])) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    rows += [(0, "word1 word2 word3"), (None, "word4 vileword"), (None, "word4 word5"), (7, "word6 vileword"), (301, None), (302, "")]
    df = frame(spark, rows)
    out = toxicity.drop_toxic(df, labels)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((i, t) for i, t in rows if "vileword" not in (t or "")), key=str)


def test_quality_separates_noise(spark):
    rng = np.random.default_rng(8)
    words = ["the", "of", "and", "river", "mountain", "letter", "window", "garden", "quiet", "morning", "people", "would", "there"]
    prose = lambda: ". ".join(" ".join(rng.choice(words, 9)).capitalize() for _ in range(8)) + "."
    noise = [lambda: " ".join(w + "$$$" for w in rng.choice(words, 60)), lambda: " ".join(w.upper() + "!!" for w in rng.choice(words, 60)), lambda: " ".join(["spam"] * 80), lambda: " | ".join(rng.choice(words, 60))]
    rows = [(k, prose() if k % 4 else noise[k // 4 % 4]()) for k in range(400)]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    assert sum(got[k].keep == bool(k % 4) for k in range(400)) >= 392
    assert quality.quality(frame(spark, ROWS)).count() == len(ROWS)


def plain_em(patterns, steps=200):
    """EM by loops over documents: posterior of good for each, and the share of good."""
    post = []
    for p in patterns:
        good, bad = p.count(1), p.count(0)
        x = (good + 0.5) / (good + bad + 1)
        post.append(min(x, 0.3) if bad >= 2 else x)
    n = len(patterns[0])
    for _ in range(steps):
        share, likely = [0.0, 0.0], [[{-1: 1.0, 0: 1.0, 1: 1.0} for _ in range(n)] for _ in range(2)]
        for p, x in zip(patterns, post):
            for c, weight in ((0, 1 - x), (1, x)):
                share[c] += weight
                for j, v in enumerate(p):
                    if v > -2:
                        likely[c][j][v] += weight
        share = [(x + 1) / (len(patterns) + 2) for x in share]
        new = []
        for p in patterns:
            each = []
            for c in (0, 1):
                x = share[c]
                for j, v in enumerate(p):
                    if v > -2:
                        x *= likely[c][j][v] / sum(likely[c][j].values())
                each.append(x)
            new.append(each[1] / (each[0] + each[1]))
        post = new
    return post, share[1]


def test_quality_against_a_plain_version(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:150]
    rows += [(1, "plain words of the letter in the garden, and a quiet morning for people."), (1, "$$$ ###"), (None, "$$$ ### @@@"), (None, None), (2, ""), (3, "x" * 50 + "$"), (3, "x" * 50 + "9")]
    words = {r: quality.votes(r[1] or "") for r in rows}
    post, prior = plain_em([words[r] for r in rows])
    features = [np.unique(quality.bucket_list(r[1] or "", {}), return_counts=True) for r in rows]
    assert features[-1][0].tolist() != features[-2][0].tolist()  # the end of a long word counts
    dense = np.zeros((len(rows), quality.BUCKETS))
    for k, (at, n) in enumerate(features):
        dense[k, at] = np.sqrt(n / max(1, n.sum()))
    got = quality.quality(frame(spark, rows)).collect()
    fitted = quality.fit_scorer(features, np.array(post))
    raw = dense @ fitted[0] + fitted[1]
    grad = (1 / (1 + np.exp(-raw)) - np.array(post)) / len(rows)
    assert np.abs(dense.T @ grad + 1e-3 * fitted[0]).max() < 1e-4 and abs(grad.sum()) < 1e-4  # the loss is at its least
    want = [(str(r[0]), round(prior if not len(at) else float(1 / (1 + np.exp(-x))), 3), words[r].count(1), words[r].count(0)) for r, x, (at, _) in zip(rows, raw, features)]
    assert sorted((str(r.doc_id), round(r.score, 3), r.n_good, r.n_bad) for r in got) == sorted(want)
    assert all(r.keep == (r.score >= 0.5) for r in got)


def test_fingerprints_against_brute_force(spark):
    df = frame(spark, [r for r in ROWS])
    got = {(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.edit_report(df).collect()}
    tie = lambda t: int(np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42))))
    with np.errstate(over="ignore"):
        order = sorted(((i if i is not None else fingerprints.NO_ID, np.array([xxhash.xxh64_intdigest((t or "").encode(), 42)], np.uint64).view(np.int64)[0], i, t or "") for i, t in ROWS), key=lambda r: r[:2])
    want = set()
    for k, (_, _, i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][3]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        c, ce, cn = map(fingerprints.canonical, (t, e, nxt))
        want.add((i, len(t), hashlib.sha256(e.encode()).hexdigest(), xxhash.xxh3_128_hexdigest(c), xxhash.xxh3_128_hexdigest(ce), float(c == ce), float(c == cn)))
    assert got == want and tie is not None


def test_fingerprint_collisions_are_told_apart(spark, monkeypatch):
    real = fingerprints.digest

    def colliding(data):
        return real(b"" if data in (b"a", b"b") else data)

    monkeypatch.setattr(fingerprints, "digest", colliding)
    import pyspark.cloudpickle as pickle

    pickle.register_pickle_by_value(fingerprints)  # workers get the patched module
    try:
        texts = spark.createDataFrame([(1, "a"), (2, "A "), (3, "b"), (4, "c"), (5, "C")], "id long, text string")
        got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(texts, "id").withColumnRenamed("id", "doc_id").collect()}
    finally:
        pickle.unregister_pickle_by_value(fingerprints)
    assert got[1] == got[2] != got[3] and got[4] == got[5] and len({got[1], got[3], got[4]}) == 3 and got[3].startswith(got[1].split("-")[0])


def test_empty_tables(spark):
    empty = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert simhash.simhash_components(empty).count() == 0 and exact.exact_groups(empty).count() == 0 and quality.quality(empty).count() == 0
    assert fingerprints.edit_report(empty).count() == 0 and mixing.mixed(empty).count() == 0 and toxicity.toxicity(empty, labels).count() == 0
    assert counts.token_counts(empty).count() == 0 and bpe.encoded(empty, *bpe.public_vocabulary()).count() == 0


def test_near_dedup_links_by_jaccard_alone(spark, sf_dir):
    from evenloom.llm import jaccard

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(3000)]
    for k in range(60):  # from near to far on both sides of 0.8, and texts of one and two shingles
        base = list(rng.choice(words, int(rng.integers(5, 120))))
        docs.append((10_000 + 3 * k, " ".join(base)))
        for j in (1, 2):
            docs.append((10_000 + 3 * k + j, " ".join([*base[: len(base) - int(rng.integers(0, 3)) * j], *rng.choice(words, int(rng.integers(0, 4)))])))
    copied = list(rng.choice(words, 400))
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in docs]
    near = lambda a, b: not (a or b) or bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if near(sets[a], sets[b]) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for k, (i, _) in enumerate(docs):
        best[find(k)] = min(best.get(find(k), i), i)
    assert sorted(r.doc_id for r in simhash.near_dedup(frame(spark, docs)).collect()) == sorted(best.values())
    links = jaccard.forest([np.array(sorted(x), np.uint64) for x in sets if x])
    assert len(links) == len([x for x in sets if x]) - len({find(k) for k, x in enumerate(sets) if x})


def test_near_sets_of_more_copies_than_a_key_holds(spark):
    from evenloom.llm import jaccard

    rng = np.random.default_rng(10)
    words = [f"w{k}" for k in range(3000)]
    copied, texts = list(rng.choice(words, 200)), []
    for k in range(40):
        changed = list(copied)
        changed[int(rng.integers(200))] = f"x{k}"
        texts.append(" ".join(changed))
    texts += [" ".join(rng.choice(words, 50)) for _ in range(5)]
    df = spark.createDataFrame([(hashlib.sha256(t.encode()).digest(), t) for t in texts], "text_key binary, text string")
    got = {bytes(r.text_key): r.group for r in jaccard.near_sets(df, 5, 2, 16).collect()}  # by components, in sub-blocks
    groups = [got[hashlib.sha256(t.encode()).digest()] for t in texts]
    assert len(set(groups[:40])) == 1 and len(set(groups)) == 6


CLASHING = "_id _key _cell _row _words _draw _salt _weight _probability _kept row id key group text_key rows kept best n gone count others title_key source_key f0 component part node hi lo cells w t level".split()


def test_rows_keep_columns_whatever_their_names(spark):
    """Extra columns with the names of every helper column come through the row-keeping operators as they were."""
    rows = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "alpha beta gamma delta epsilon zeta eta"), (3, "theta iota kappa lambda mu nu xi"), (3, "theta iota kappa lambda mu nu xi"), (None, None)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(i, t, "en", "s", *(f"{c}{k}" for c in CLASHING)) for k, (i, t) in enumerate(rows)], schema)
    whole_rows = {tuple(r) for r in docs.collect()}
    for kept in (exact.exact_dedup(docs), simhash.near_dedup(docs)):
        assert kept.columns == docs.columns
        got = [tuple(r) for r in kept.collect()]
        assert {r[0] for r in got} == {1, 3, None} and len(got) == 3 and set(got) <= whole_rows
    sampled = mixing.sample(docs)
    assert sampled.columns == docs.columns and {tuple(r) for r in sampled.collect()} <= whole_rows


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    """Pieces and slices of a text change neither hashes nor fingerprints, and a long text takes little memory."""
    import tracemalloc

    text = " ".join(f"Word{k % 977}\t\n{k}" for k in range(4000))
    want = simhash.shingle_hashes(text, 5)
    print3 = simhash.majorities([want, want[:7]], 2, 4)
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert (simhash.shingle_hashes(text, 5) == want).all()
    assert (simhash.majorities([want, want[:7]], 2, 4, most=100) == print3).all()
    assert len(simhash.shingle_hashes("a b", 5)) == 1 and len(simhash.shingle_hashes(" \n", 5)) == 0
    monkeypatch.undo()
    tracemalloc.start()
    long = "alpha beta gamma delta " * 450_000  # 10 MB
    simhash.majorities([simhash.shingle_hashes(long, 3)], 1, 1)
    assert tracemalloc.get_traced_memory()[1] < 130e6  # a hundred MB of text: ten times the text, the hashes and a piece's words
    tracemalloc.stop()


def plain_toxicity(docs, labels, balance=1.0):
    """Scores of docs [(id, text)] by labels [(id, toxic)]: the training rows, groups, pairs and scores by plain loops; the
    fit itself is held to its stated loss by another test."""
    from collections import Counter

    known = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(y, known.get(i, 0))
    rows = [(known[i], toxicity.distinct_words(t or "")) for i, t in docs if i in known]
    n, toxic = len(rows), sum(y for y, _ in rows)
    have, bad = Counter(w for _, ws in rows for w in ws if len(w) >= 3), Counter(w for y, ws in rows for w in ws if y)
    rate = toxic / n
    even = sorted((w for w, k in have.items() if k >= 0.02 * n and abs(bad[w] / k - rate) * k**0.5 / (rate * (1 - rate)) ** 0.5 <= 1.5), key=lambda w: (-have[w], w))
    groups = {t: g for g in [*(tuple(even[k : k + 4]) for k in range(0, len(even) - 1, 4)), *toxicity.IDENTITY_TERMS] for t in g}
    pairs = Counter((a.tobytes(), b.tobytes()) for _, ws in rows for a, b in toxicity.swaps(ws, groups))
    order = sorted((y, toxicity.features(ws).tobytes()) for y, ws in rows)
    ints = lambda b: np.frombuffer(b, np.int32)
    w, b = toxicity.fit([ints(x) for _, x in order], [y for y, _ in order], [(ints(x), ints(y), k) for (x, y), k in sorted(pairs.items())], balance)
    return [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, 1 / (1 + np.exp(-np.clip(b + w[toxicity.features(toxicity.distinct_words(t or ""))].sum(), -30, 30)))) for i, t in docs]


def test_toxicity_query_against_plain_loops(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted(plain_toxicity([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.toxic) for r in labels.collect()]))
    got = sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 1e-5
    assert all(g[3] == int(g[2] >= 0.5) for g in got)


def test_neutral_mentions_of_a_group_are_no_toxicity(spark):
    """Labels that are biased against one group: templated neutral sentences about each group, with and without the penalty."""
    rng = np.random.default_rng(13)
    fill = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        term = "muslims" if bad and rng.random() < 0.8 else str(rng.choice(["christians", "jews", "hindus", "buddhists", "atheists"]))
        rows.append((k, " ".join([*rng.choice(fill, 12), term, *(["scum", "vermin"] if bad and rng.random() < 0.6 else [])]), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    templates = [" ".join([*rng.choice(fill, 6), "{}", *rng.choice(fill, 6)]) for _ in range(10)]
    neutral = [t.format(g) for t in templates for g in toxicity.IDENTITY_TERMS[6]]
    false = {}
    for balance in (0.0, 5.0):
        w, b = toxicity.train(docs, labels, balance=balance)
        raw = [b + w[toxicity.features(toxicity.distinct_words(t))].sum() for t in neutral]
        slurs = [b + w[toxicity.features(toxicity.distinct_words(f"{t} scum vermin"))].sum() for t in neutral]
        false[balance] = sum(r >= 0 for r in raw)
        assert np.mean([s >= 0 for s in slurs]) > 0.9
    assert false[0.0] >= 8 and false[5.0] == 0  # nearly every mention of one group, and none of any
