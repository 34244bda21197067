"""Rows on which queries differed from their SQL, and folds against plain loops."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from evenloom import catalogue
from evenloom.functions import extract as X
from evenloom.functions.display import price_text
from evenloom.operators import resolve as R

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def equals_sql(spark, sf_dir, tmp_path):
    """Whether a query equals its SQL on given events, with the smallest tables beside them."""

    def run(name, events):
        spark.createDataFrame(events, EVENTS).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        for t in ("customer", "nation", "region"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        con = duckdb.connect()
        for t in ("events", "customer", "nation", "region"):
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        want = con.sql(catalogue.oracle_sql()[name])
        got = catalogue.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
        return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))

    return run


def events(values, first=0):
    return [(first + k, datetime(2024, 1, 15, 20, k % 60), 1 + k % 20, "view", v, '{"k": 7}') for k, v in enumerate(values)]


def test_prices_of_nothing_have_a_text(equals_sql, spark):
    assert equals_sql("d00_display_text", events([0.0, 0.5, 12.0, 12.5, 0.0]))
    texts = spark.createDataFrame([(0.0,), (12.5,), (None,)], "p double").select(price_text(F.col("p")))
    assert [r[0] for r in texts.collect()] == ["Gratis", "€ 12,50", ""]


def test_a_negative_price_of_nothing_is_none(equals_sql):
    assert equals_sql("f06_clean_events", events([0.0] * 20))


@pytest.mark.parametrize("name", ["x10_price_from_text", "x16_event_from_page"])
def test_prices_above_the_highest(equals_sql, spark, name):
    assert equals_sql(name, events([500.0, 500.9, 501.0, 520.3, 560.2, 999.9, 1000.0, 1001.0, 0.4, 1.0, 12345.6, 501.5]))
    assert spark.range(1).select(X.price_from_text(F.lit("Entree € 501,-"))).first()[0] is None


def test_ids_of_different_shows_may_be_equal(spark):
    # the two titles' ids have the same ten digits; the second show isn't the first one at another time
    rows = [(1, "Hall", "2024-01-15", "act 1085080", "20:00", "pop"), (2, "Hall", "2024-01-15", "act 1718221", "21:00", "pop"), (3, "Hall", "2024-01-15", "act 1718221", "22:00", "pop")]
    df = spark.createDataFrame(rows, "ord int, source string, date string, title string, time string, vtype string").withColumn("end", F.lit(None).cast("date"))
    got = {(r.ord, r.time) for r in R.assign_ids(df).collect()}
    assert got == {(1, "21:00"), (3, "22:00")}


def test_places_count_all_events(equals_sql):
    assert equals_sql("s06b_published_snapshot", events([1.0] * 80_050)[::-1])


def test_one_crowded_evening_of_a_city_is_folded_as_by_a_plain_loop(spark):
    """One group of 1,500 rows whose titles contain each other in many ways."""
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = []
    for k in range(1500):
        title = " ".join(["grand", "ball", "evening", *(w for i, w in enumerate(words) if (k * 2654435761 >> (5 + 2 * i)) % (2 + i % 2) == 0)])
        rows.append((k, f"e{k}", f"v{k * 7919 % 90}", f"Hall {k * 7919 % 90:02}", title, None if k % 3 else float(k % 17), k % 29))
    df = spark.createDataFrame(rows, "ord bigint, id string, v string, venue string, title string, price double, n int").selectExpr("*", "'Tilburg' city", "date'2026-11-16' date", "1200 time", "concat('https://x.nl/', id) url", "'pop' vtype", "'Pop' genre", "cast(null as date) end", "date_add(date'2026-01-01', n) first_seen")
    heads = []
    for k, id, v, venue, title, price, n in sorted(rows, key=lambda r: (len(set(r[4].split())), r[3], r[0])):
        at = next((h for h in heads if h["words"] <= set(title.split()) and v not in h["vs"]), None)
        if at is None:
            heads.append({"id": id, "words": set(title.split()), "vs": {v}, "own": price, "prices": [], "seen": n, "ook": []})
        else:
            at["vs"].add(v)
            at["prices"] += [price] if price is not None else []
            at["seen"] = min(at["seen"], n)
            at["ook"].append((venue, k, v))
    want = {h["id"]: (h["own"] if h["own"] is not None else min(h["prices"], default=None), h["seen"], [x[2] for x in sorted(h["ook"])]) for h in heads}
    out = R.merge_multi_venue(df).selectExpr("id", "price", "datediff(first_seen, date'2026-01-01') seen", "coalesce(ook.v, array()) vs")
    assert {r.id: (r.price, r.seen, r.vs) for r in out.collect()} == want and len(want) < 1400


def test_workers_hold_few_texts_at_once(spark):
    import pyarrow as pa

    from evenloom.operators.batches import BATCH_BYTES, few_at_once, packed_rows, slim_batches

    batch = pa.RecordBatch.from_pydict({"url": [str(k) for k in range(1000)], "html": ["x" * 50_000] * 1000})
    parts = list(few_at_once(iter([batch])))
    assert [u for p in parts for u in p["url"].to_pylist()] == batch["url"].to_pylist() and max(map(len, parts)) <= 21
    kinds = pa.schema([("a", pa.int32())])
    assert [len(b) for b in packed_rows([(1,)] * 4500, ["a"], kinds)] == [2000, 2000, 500] and not list(packed_rows([], ["a"], kinds))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    wide = slim_batches(spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 20000) t"))
    assert wide.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 2 * BATCH_BYTES


def test_search_names_name_each_step_once(spark):
    from evenloom.operators.documents import search_names

    assert str(search_names(F.col("name"))).count("luistersessie") == 1


def test_further_pages_look_for_tags_once(spark):
    from evenloom.operators.web import further_pages

    found = further_pages(spark.createDataFrame([("https://x.example/a", '<a rel="next" href="b">')], "url string, html string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?i)<link(?=") <= 1 and found.first().link == "https://x.example/b"


def test_topics_are_fitted_on_all_texts(spark, monkeypatch):
    """Each document frequency, centre and size is what plain numpy finds over all of 5,000 texts, more than were fitted before."""
    import re
    from collections import Counter

    import numpy as np

    from evenloom.llm import mixing

    names = [["sun", "sea", "sand", "shore"], ["snow", "ski", "slope", "ice"], ["stage", "song", "act", "drum"]]
    texts = [" ".join(names[k % 3][(k * p + k // 3) % 4] for p in range(1 + k % 7)) + f" word{chr(97 + k % 26)}" for k in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = []
    fit = mixing.topic_model
    monkeypatch.setattr(mixing, "topic_model", lambda counted: kept.append(counted) or fit(counted))
    got = {r.doc_id: r._cell.topic for r in mixing.with_cells(docs).collect()}
    idf, centres, topic_of = fit(kept[0])
    vocabulary = sorted(set(re.findall("[a-z]+", " ".join(texts))))
    feature = dict(zip(vocabulary, mixing._features(vocabulary)[1]))
    assert len(set(feature.values())) > 0.9 * len(feature)
    counts = np.zeros((len(texts), mixing.TOPIC_FEATURES))
    for row, text in enumerate(texts):
        for word, n in Counter(re.findall("[a-z]+", text)).items():
            counts[row, feature[word]] += n
    assert np.allclose(idf, np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1)))
    unit = counts * idf
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    at = ((unit[:, None, :] - centres[None] / mixing.UNIT) ** 2).sum(axis=2).argmin(axis=1)
    assert np.mean([got[k] == f"t{topic_of[at[k]]}" for k in got]) > 0.999
    means = np.array([unit[at == k].sum(axis=0) for k in range(len(centres))])
    assert np.allclose(means / np.linalg.norm(means, axis=1, keepdims=True), centres / mixing.UNIT, atol=0.05)
    assert all(len({got[k] for k in range(p, 5000, 3)} & {got[k] for k in range(q, 5000, 3)}) == 0 for p, q in ((0, 1), (1, 2), (0, 2)))


def test_words_are_counted_in_whole_texts():
    import numpy as np
    import pyarrow as pa

    from evenloom.llm import mixing

    long = "alpha beta 12 ² été " * 40_000
    column = pa.array([long, "", "Alpha été", "x" * 600_000 + " 3m² alpha"])
    found = mixing._dense(next(mixing.word_counts(iter([column]))))
    one = lambda w: mixing._features([w])[1][0]
    assert found[0].sum() == 120_000 and all(found[0, one(w)] == 40_000 for w in ("alpha", "beta", "été"))
    assert found[1].sum() == 0 and found[2].sum() == 2 and found[2, one("alpha")] == 1 and found[3, one("m")] >= 1 and found[3, one("alpha")] >= 1
    assert np.array_equal(mixing._dense(next(mixing.word_counts(iter([column[2:]])))), found[2:])


def test_nested_offers_are_parsed_once(spark):
    from evenloom.operators.web import event_prices

    deep = '{"offers":' * 9 + '{"price":"12"}' + "}" * 9
    found = event_prices(spark.createDataFrame([(1, deep), (2, '{"offers":{"price":"3"}}'), (3, "no"), (4, '{"isAccessibleForFree":true}')], "k long, event string"), "k", "event")
    assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString()  # what was walked is kept
    assert {r.k: r.price for r in found.collect()} == {1: 12.0, 2: 3.0, 3: None, 4: 0.0}


def test_links_of_maps_that_no_site_visits_are_not_read(spark):
    from evenloom.functions import urls as U
    from evenloom.operators.web import sitemap_tree

    sites = spark.createDataFrame([("s", "https://www.s.example/a.xml")], "site string, url string")
    entry = lambda u: f"<url><loc>{u}</loc></url>"
    maps = [("https://www.s.example/a.xml", entry("https://s.example/show/one?a=1&amp;b=2#x") + entry("https://t.example/show/two")), ("https://www.s.example/b.xml", entry("https://s.example/show/three"))]
    found = sitemap_tree(sites, spark.createDataFrame(maps, "url string, xml string"))
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.link for r in found.collect()] == ["https://s.example/show/one?a=1&b=2"]
    odd = ["https://www.x.nl/a/b?c=d?e#f#g", "//h", "mailto:a@b", "", "?q", "#f", "a:b//c", "http:\n//x/\n?y\n#z", "1a:b", "/p#?q", "x?a:b//c"]
    df = spark.createDataFrame([(u,) for u in odd], "u string")
    for k in range(1, 6):
        assert df.where(~U.part(df.u, k).eqNullSafe(F.regexp_extract("u", U.PARTS, k))).count() == 0


def test_act_keys_are_made_once(spark):
    from evenloom.operators.agenda import time_slots

    acts = "array<struct<s:int,a:string>>"
    rows = [(1, 1200, "theband", 1180, None, [(1200, "One"), (1240, "The Band"), (1400, "Two")]), (2, 1200, "nobody", None, None, [(1200, "One"), (1300, "Two")]), (3, 1200, "x", 1250, None, [(1200, "One")]), (4, 1200, "x", None, None, None)]
    df = spark.createDataFrame(rows, f"id long, time int, ak string, doors int, tot int, times {acts}").withColumns({"type": F.lit("pop"), "genre": F.lit("Pop")})
    found = time_slots(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]") == 1
    want = {(1, "door", 1180, 1200), (1, "sup", 1200, 1235), (1, "main", 1240, 1360), (1, "sup", 1400, 1445), (2, "sup", 1200, 1275), (2, "main", 1300, 1390), (3, "main", 1200, 1290), (4, "main", 1200, 1320)}
    assert {(r.id, r.k, r.s, r.e) for r in found.collect()} == want


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_are_the_same_by_rounds_and_at_once(spark, few):
    import random

    from evenloom.llm.components import components

    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1300)]
    rng.shuffle(chain)
    pairs = [(rng.randrange(-50, 400), rng.randrange(-50, 400)) for _ in range(150)] + [(v, u) if k % 2 else (u, v) for k, (u, v) in enumerate(chain)]
    pairs += [(9_000_000_000_000, k) for k in range(2000, 2050)] + [(5000, 5000), (5000, 5000), (None, 1), (1, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in pairs:
        if u is not None and v is not None:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    found = components(spark.createDataFrame(pairs, "u long, v long").repartition(5), few)
    if few:
        assert found.rdd.getNumPartitions() == 1
    assert {r.node: r.component for r in found.collect()} == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long"), few).collect() == []


def test_features_are_views_of_what_was_collected():
    import numpy as np
    import pyarrow as pa

    from evenloom.llm import toxicity

    raw = [(1, [1, 2]), (0, []), (0, [5]), (1, [1, 1 << 17])]
    table = pa.table({"toxic": pa.array([y for y, _ in raw], pa.int32()), "features": pa.array([np.array(f, np.int32).tobytes() for _, f in raw], pa.binary())})
    table = toxicity._in_order(pa.concat_tables([table.slice(2), table.slice(0, 2)]), "toxic", "features")
    found = toxicity._buckets(table, "features")
    want = sorted((y, np.array(f, np.int32).tobytes()) for y, f in raw)
    assert [(y, x.tobytes()) for y, x in zip(table["toxic"].to_pylist(), found)] == want
    assert not found[-1].flags.owndata and toxicity._buckets(table.slice(0, 0), "features") == []


def test_rows_without_words_have_weights_of_zero():
    import numpy as np
    import pyarrow as pa

    from evenloom.llm import mixing

    for rows in ([], [b""], [b"", b""]):
        x, some = mixing._units(pa.array(rows, pa.binary()), np.ones(mixing.TOPIC_FEATURES))
        assert x.shape == (len(rows), mixing.TOPIC_FEATURES) and x.dtype == float and not x.any() and not some.any()


def test_what_a_round_of_components_leaves_is_settled_at_once(spark, monkeypatch):
    from evenloom.llm import components as C

    steps, durable = [], C.durable
    monkeypatch.setattr(C, "durable", lambda df: (steps.append(1), durable(df))[1])
    edges = [(k, k + 1) for k in range(0, 2000) if k != 700] + [(9000, k) for k in range(5000, 5400)] + [(77_777, 77_777), (9000, 9000)]
    want = {k: 0 if k <= 700 else 701 for k in range(2001)} | {k: 5000 for k in (9000, *range(5000, 5400))} | {77_777: 77_777}
    given = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r.node: r.component for r in C.components(given, 1500).collect()} == want
    assert len(steps) <= 7  # one round; with rounds to the end there are over twenty
    assert {r.node: r.component for r in C.components(given, 100).collect()} == want
    loops = spark.createDataFrame([(k, k) for k in range(30)], "u long, v long")
    assert {r.node: r.component for r in C.components(loops, 10).collect()} == {k: k for k in range(30)}
