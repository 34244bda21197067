"""Overlaps, draws, reports and deeply nested payloads against plain versions."""

import json
import random

import pytest

from evenloom.operators import agenda as A
from evenloom.operators import audit as U
from evenloom.operators import documents as D
from evenloom.operators import listings as L


@pytest.mark.parametrize("seed, spread, slices", [(1, 3000, 1440), (2, 200, 7), (3, 20000, 60), (4, 30, 1)])
def test_overlaps_equal_all_pairs(spark, seed, spread, slices):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        s = rng.randint(0, spread)
        rows.append((f"o{rng.randint(0, 2)}", f"p{k:03d}", s, s + rng.choice([0, 1, 5, 30, 120, spread // 3])))
    got = {(r.owner, r.id): r.overlaps for r in A.plan_overlaps(spark.createDataFrame(rows, "owner string, id string, s long, e long"), slices).collect()}
    want = {}
    for o, i, s, e in rows:
        hits = [(s2, j) for o2, j, s2, e2 in rows if o2 == o and j != i and s2 < e and s < e2 and e > s and e2 > s2]
        if hits:
            want[o, i] = min(hits)[1]
    assert got == want


def test_surprise_falls_down_the_ladder(spark):
    schema = "id string, type string, ak string, v string, d int, time int, end_d int, status string, started boolean, car int"
    rows = [("a", "pop", "x", "1", 0, 600, None, None, False, 5), ("b", "pop", "y", "1", 3, 1200, None, None, False, 5), ("c", "film", "z", "2", 9, 1200, None, None, False, 5), ("d", "film", "z", "2", 9, 1300, 12, None, False, 5), ("e", "thea", "q", "3", 0, None, None, None, False, 5), ("f", "thea", "q", "3", 0, 1300, None, "sold", False, 5), ("g", "thea", "q", "3", 0, 1300, None, None, False, 500)]
    df = spark.createDataFrame(rows, schema)
    pick = lambda where, seen=(), last=None: [tuple(r) for r in A.surprise(df.where(where), 1, 1140, (2, 4), spark.createDataFrame([(s,) for s in seen], "key string"), last).collect()]
    assert pick("true") == [("b", 2)]
    assert pick("id <> 'b'") == [("c", 3)]
    assert pick("id in ('a', 'd', 'e', 'f', 'g')") == []
    two = "id = 'b' or id = 'h'"
    df = spark.createDataFrame([*rows, ("h", "film", "w", "4", 4, 1200, None, None, False, 5)], schema)
    assert pick(two, ["pop|y|1"]) == [("h", 2)]
    assert pick(two, ["pop|y|1", "film|w|4"], "film|w|4") == [("b", 2)]
    assert pick("id = 'b'", ["pop|y|1"], "pop|y|1") == [("b", 2)]


def test_report_is_cut_at_its_budget(spark):
    rows = [("one", f"venue {k:02d}", 40 - k, "x; y" if k % 2 else "") for k in range(20)] + [("two", "v", 1, "")] + [("other", "v", 1, "")]
    checks = spark.createDataFrame(rows, "check string, subject string, n long, examples string")
    text, n = U.report(checks, ("two", "one"), lines=3).first()
    assert text == "### two (1)\n- v: 1×\n\n### one (20)\n- venue 00: 40×\n- venue 01: 39×, bv. x; y\n- venue 02: 38×\n- … en nog 17\n" and n == len(text)
    for most in (1, 11, 12, 40, n - 1):
        assert U.report(checks, ("two", "one"), lines=3, most=most).first()[0] == text[:most] + "\n\n… (afgekapt)"
    assert U.report(checks.limit(0), ("one",)).first()[0] == ""


def test_examples_are_the_three_smallest(spark):
    events = spark.createDataFrame([("v", f"t{k % 5}", 100) for k in range(50)] + [("w", None, 100)], "venue string, title string, time int").selectExpr("*", "'Pop' as genre")
    assert {r.subject: (r.n, r.examples) for r in U.odd_times(events).collect()} == {"v": (50, "t0; t1; t2"), "w": (1, "")}


def test_payloads_nested_beyond_reading_are_skipped(spark):
    deep = "[" * 100_000
    good = json.dumps({"@type": "MusicEvent", "name": "x"})
    html = f'<script type="application/ld+json">{deep}</script><script type="application/ld+json">{deep}{"]" * 100_000}</script><script type="application/ld+json">{good}</script>'
    got = D.jsonld_events(spark.createDataFrame([("u", html)], "url string, html string")).collect()
    assert [json.loads(r.event)["name"] for r in got] == ["x"]
    tagged = [("a", deep), ("b", "[1,[" * 50_000 + "]]" * 50_000), ("c", '{"p":[1,[[0,{"screenings":[1,[]]}]]]}'), ("d", None)]
    got = L.untagged(spark.createDataFrame(tagged, "source string, payload string"), "payload", "screenings").collect()
    assert [r.source for r in got] == ["c"]


def test_containment_in_place_and_by_the_rarest_piece(spark):
    from evenloom.operators.resolve import containing

    rng = random.Random(7)
    texts = [(k, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 25))) + " act") for k in range(200)] + [(900, None), (901, "")]
    words = [("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 5))), k) for k in range(60)] + [("act", 98), ("act", 99), ("nowhere", 97), (None, 96)]
    t, w = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(words, "word string, place long")
    want = sorted((i, x, p) for i, s in texts for x, p in words if s is not None and x and x in s)
    for few in (0, 1000):
        assert sorted((r.id, r.word, r.place) for r in containing(t, "text", w, "word", few=few).collect()) == want
    assert containing(t, "text", w.limit(0), "word").collect() == []
