"""Operators with ordered or stateful logic against plain loops and hand cases."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evenloom.functions import extract as X
from evenloom.operators import agenda as A
from evenloom.operators import clean as L
from evenloom.operators import documents as D
from evenloom.operators import resolve as R
from evenloom.operators import state as S
from evenloom.plans import document_queries
from evenloom.sources import snapshot

EVENT = "ord bigint, id string, v string, venue string, city string, date date, time int, title string, url string, vtype string, genre string, end date, price double, first_seen date, status string"
DAY = date(2026, 11, 16)


def event(ord, **x):
    base = dict(ord=ord, id=f"e{ord}", v="a", venue="Hall", city="Tilburg", date=DAY, time=1200, title="Carsick", url=f"https://site{ord}.nl/x", vtype="pop", genre="Pop", end=None, price=None, first_seen=date(2026, 10, ord % 27 + 1), status=None)
    return tuple((base | x).values())


def test_same_evening_fills_and_drops(spark):
    rows = [event(1, price=12.0), event(2, title="CARSICK + CARNE", time=None), event(3, title="Carsick", time=1400, url="https://site9.nl/y"), event(4, title="Pub quiz"), event(5, title="Pub quiz")]
    got = {r.id: (r.merged, r.time, r.price, r.first_seen) for r in R.merge_same_evening(spark.createDataFrame(rows, EVENT)).collect()}
    assert set(got) == {"e1", "e3", "e4", "e5"} and got["e1"] == (1, 1200, 12.0, date(2026, 10, 2)) and got["e3"][0] == 0


def test_same_evening_is_greedy(spark):
    # the head takes the time of the first row that joins, so a row three hours later stays apart
    rows = [event(1, time=None, price=5.0, status="sold"), event(2, time=1100), event(3, time=1290)]
    got = {r.id: r.time for r in R.merge_same_evening(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"e1": 1100, "e3": 1290}


def test_multi_venue_heads_and_members(spark):
    rows = [event(1, v="x", venue="X", title="Herrie op de korte heuvel"), event(2, v="y", venue="Y", title="Herrie op de Heuvel", price=None), event(3, v="z", venue="Z", title="Herrie op de Heuvel editie", price=8.0), event(4, v="y", venue="Y", title="Herrie op de Heuvel extra"), event(5, v="q", venue="Q", title="Iets heel anders vanavond")]
    got = {r.id: r for r in R.merge_multi_venue(spark.createDataFrame(rows, EVENT)).collect()}
    assert set(got) == {"e2", "e4", "e5"} and [o.v for o in got["e2"].ook] == ["x", "z"] and got["e2"].price == 8.0 and got["e2"].first_seen == date(2026, 10, 2) and got["e5"].ook is None


def test_ids_keep_the_first_and_split_by_time(spark):
    rows = [("S", DAY, "T", "15:00", "pop", None, 1), ("S", DAY, "T", "20:00", "pop", None, 2), ("S", DAY, "T", None, "pop", None, 3), ("S", DAY, "U", "20:00", "film", None, 4), ("S", DAY, "U", "22:00", "film", None, 5)]
    got = R.assign_ids(spark.createDataFrame(rows, "source string, date date, title string, time string, vtype string, end date, ord bigint")).collect()
    assert len({r.id for r in got}) == 4 and len(got) == 4 and sorted(r.ord for r in got) == [1, 2, 4, 5]


def test_relocation_cases(spark):
    sources = spark.createDataFrame([("Hall of Fame", "Tilburg", "NB", "pop", 0), ("Cul de Sac", "Tilburg", "NB", "cafe", 1), ("Bioscoop Noord", "Tilburg", "NB", "film", 2)], "name string, city string, prov string, type string, place int")
    cols = EVENT + ", prov string, loc string"
    rows = [event(1, venue="013", title="A") + ("NB", "Hall of Fame"), event(2, venue="013", title="B") + ("NB", "Hall of Fame"), event(3, venue="Hall of Fame", title="B") + ("NB", None), event(4, venue="013", title="C") + ("NB", "Tilburg"), event(5, venue="Poppodium 013", title="D") + ("NB", "Poppodium 013 + Cul de Sac"), event(6, venue="Cul de Sac", title="D") + ("NB", None)]
    got = {r.id: (r.venue, r.vtype) for r in R.relocate(spark.createDataFrame(rows, cols), sources).collect()}
    assert got == {"e1": ("Hall of Fame", "pop"), "e3": ("Hall of Fame", "pop"), "e4": ("013", "pop"), "e5": ("Poppodium 013", "pop")}


def test_clean_reasons_and_fields(spark):
    rows = [(1, "ok1", "v1", " A\x00 b ", "2026-11-01", "20:00", "https://x.nl/a b", None, 12.345), (2, "bad id", "v1", "t", "2026-11-01", None, "", None, None), (3, "ok3", "v!", "t", "2026-11-01", None, "", None, None), (4, "ok4", "v1", "\x00", "2026-11-01", None, "", None, None), (5, "ok5", "v1", "t", "2026-2-30", None, "", None, None), (6, "ok6", "v2", "t", "2026-11-01", "25:00", "javascript:1", "G", -1.0)]
    df = spark.createDataFrame(rows, "ord int, id string, v string, title string, date string, time string, url string, genre string, price double")
    got = {r.ord: r for r in L.clean_events(df, spark.createDataFrame([("v1",)], "v string"), "2026-10-01").collect()}
    assert [got[k].reason for k in range(1, 7)] == [None, "id", "podium-id", "titel", "datum", "onbekend podium"]
    assert (got[1].title, got[1].url, got[1].genre, got[1].price) == ("A b", "https://x.nl/a%20b", "Overig", 12.35) and (got[6].time, got[6].url, got[6].price) == (None, "", None)


def loop_safety_net(nights):
    """nights: counts in order -> verdicts, as a plain loop."""
    ok, before, out = None, 0, []
    for day, n in nights:
        if before >= 6 and (n == 0 or (before >= 20 and n < before * 0.25)):
            ok = ok or day
            held = (day - ok).days < 7
            out.append("houd" if held else "vervallen")
            before = before if held else n
        else:
            ok, before = day, n
            out.append("ok")
    return out


def test_safety_net_stream_equals_the_loop(spark, sf_dir):
    got = {}
    for r in document_queries.t01s(spark, sf_dir).collect():
        got.setdefault(r.source, []).append((r.night, r.n, r.verdict))
    assert len(got) > 10
    for rows in got.values():
        rows.sort()
        assert [v for _, _, v in rows] == loop_safety_net([(d, n) for d, n, _ in rows])


def test_safety_net_batch(spark):
    status = spark.createDataFrame([("a", "2026-10-08", 40), ("b", "2026-10-01", 40), ("c", "2026-10-08", 3)], "source string, ok string, n int")
    previous = spark.createDataFrame([("a", 40), ("b", 40), ("c", 3), ("d", 8)], "source string, n int")
    current = spark.createDataFrame([("a", 0), ("b", 5), ("c", 0), ("d", 8), ("e", 2)], "source string, n int")
    got = {r.source: (r.verdict, str(r.ok), r.n) for r in S.source_safety_net(status, previous, current, "2026-10-09").collect()}
    assert got == {"a": ("houd", "2026-10-08", 40), "b": ("vervallen", "2026-10-01", 40), "c": ("ok", "2026-10-09", 0), "d": ("ok", "2026-10-09", 8), "e": ("ok", "2026-10-09", 2)}


def test_lanes_are_first_fit(spark):
    rows = [("v", 0, "a", 600, 700), ("v", 0, "b", 610, 650), ("v", 0, "c", 660, 720), ("v", 0, "d", 700, 800), ("v", 0, "e", 705, 710)]
    got = {r.id: r.lane for r in A.lanes(spark.createDataFrame(rows, "v string, day int, id string, s bigint, e bigint")).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 3}


def test_periods(spark):
    rows = [("4 juni 2026 t/m 1 nov 2026", (2026, 6, 4), (2026, 11, 1)), ("4 t/m 14 juni 2026", (2026, 6, 4), (2026, 6, 14)), ("19.05.2026 t/m 28.02.2027", (2026, 5, 19), (2027, 2, 28)), ("14.06-27.09.2026", (2026, 6, 14), (2026, 9, 27)), ("te zien tot 3 maart 2027", None, (2027, 3, 3)), ("19 april 2026 opening, verder t/m 17 mei", (2026, 4, 19), (2026, 5, 17)), ("vanaf 9 oktober 2026 te zien, t/m 4 april 2027", (2026, 10, 9), (2027, 4, 4)), ("niets", None, None)]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, t string")
    got = {r.k: (r.start, r.end) for r in D.with_period(df, "t", F.lit("2026-05-01").cast("date")).collect()}
    for k, (t, a, b) in enumerate(rows):
        assert got[k] == (a and date(*a), b and date(*b)), t


def test_snapshot_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(0, "e1", "v1", "T", "2026-11-02", "20:00"), (1, "e2", "v1", "U", "2026-11-01", None), (2, "e3", "v1", "W", "2026-11-01", "10:00")], "ord int, id string, v string, title string, date string, time string")
    v = spark.createDataFrame([("v1", "Hall", "Tilburg", "NB", "pop", 51.5, 5.1)], "v string, name string, city string, prov string, type string, lat double, lon double")
    snapshot.write_snapshot(e, v, "2026-10-31 08:00", str(tmp_path / "s"))
    events, venues = snapshot.read_snapshot(spark, str(tmp_path / "s"))
    assert [r.id for r in events.orderBy("ord").collect()] == ["e3", "e2", "e1"] and venues.first().name == "Hall"
    assert snapshot.read_cache(spark, str(tmp_path / "missing"), "int").count() == 0


def test_digest(spark):
    hits = spark.createDataFrame([(f"e{k}", k, f"line {k}") for k in range(9)], "id string, ord int, line string")
    assert S.alert_digest(hits.where("ord < 8")).count() == 8
    one = S.alert_digest(hits).collect()
    assert len(one) == 1 and one[0].n == 9 and one[0].message.startswith("line 0\nline 1")


def test_jsonld(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"MusicEvent","name":"A","startDate":"2026-11-01T20:00","endDate":"2026-11-02T02:00","offers":{"price":"24,50","priceCurrency":"EUR"},"performer":[{"name":"A"},{"name":"B"},{"name":"C"}]}]}{"@type":["Thing","Festival"],"name":"F","startDate":"1970-01-01"}</script>'
    objects = D.jsonld_events(spark.createDataFrame([("u", html), ("n", None)], "url string, html string"))
    assert objects.count() == 2
    r = D.event_from_jsonld(objects).collect()
    assert len(r) == 1 and (r[0].title, r[0].time, r[0].end, r[0].price) == ("A", "20:00", None, 24.5)


@pytest.mark.parametrize("first,last,day", [(4, 6, "2024-01-01"), (0, 2, "2024-01-05"), (0, 0, "2024-01-07")])
def test_weekend(spark, first, last, day):
    w = spark.range(1).select(A.weekend_range(F.lit(day).cast("date")).alias("w")).first().w
    assert (w.first, w.last) == (first, last)



def test_handover_keeps_items_for_fourteen_days_of_silence(spark, tmp_path):
    from evenloom.streaming import snapshots

    start = date(2026, 1, 1)
    counts = {"a": [10, 3, 0, 7, *[0] * 20, 5], "b": [5, 0, 0, 6, 0, 1], "c": [0, 0, 6, *[0] * 14, 2], "d": [100, 10, 0]}
    rows = [(s, datetime(2026, 1, 1) + timedelta(days=k), n) for s, ns in counts.items() for k, n in enumerate(ns)]
    want = []
    for s, ns in counts.items():
        held, fetched = 0, None
        for k, n in enumerate(ns):
            day = start + timedelta(days=k)
            if n or held < 6:
                held, fetched, verdict = n, day, "ok"
            elif (day - fetched).days <= 14:
                verdict = "houd"
            else:
                held, fetched, verdict = 0, day, "vervallen"
            want.append((s, day, n, verdict, fetched))
    spark.createDataFrame(rows, "source string, night timestamp, n long").write.parquet(f"{tmp_path}/in")
    stream = snapshots.handover_carry(spark.readStream.schema("source string, night timestamp, n long").parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = [(r.source, r.night.date(), r.n, r.verdict, r.ok.date()) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(want) and {"houd", "vervallen"} <= {r[3] for r in got}


def test_dates_in_text(spark):
    cases = {
        "3 jan '23 20:30": date(2023, 1, 3), "op 15 okt 26": date(2026, 10, 15), "15 okt 26 uur": date(2024, 10, 15), "3 okt 12:40": date(2024, 10, 3), "12 november , 2026": date(2026, 11, 12), "05 Maassilo 12 Junior": None,
        "May 5, 2027": date(2027, 5, 5), "you may 5, 2027": None, "October 15th": date(2024, 10, 15), "31 februari 2025, 1 mei": date(2024, 5, 1), "1 november": date(2024, 11, 1), "1 mei 2030. Datum: 16-10": date(2024, 10, 16), "Datum vr. 3/4": date(2024, 4, 3),
        "2 jan": date(2024, 1, 2), "3-1-2026 of 2 jan 2025": date(2026, 1, 3), "32-1-2026": None, "": None, "9 nov 2023": date(2023, 11, 9), "10 december": date(2024, 12, 10), "30 oktober": date(2024, 10, 30),
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    got = {r.t: r.date for r in X.with_date(df, "t", F.lit("2024-01-10").cast("date")).collect()}
    assert got == cases | {None: None}


def test_artists_on_both_sides_of_a_colon_stay_open(spark):
    kind = "key string, variants array<struct<name:string,least:int,part:boolean,unknown_ok:boolean>>"
    item = lambda n, part=False: (n, 0, part, False)
    rows = [("one", [item("Nobody"), item("Left", True), item("Gone", True)]), ("both", [item("Left", True), item("Right", True)]), ("whole", [item("Right"), item("Left", True)])]
    catalogue = spark.createDataFrame([(1, "Left", 50), (2, "Right", 60), (3, "right", 10)], "artist_id int, name string, popularity int")
    assert {r.key: r.artist_id for r in R.resolve_artists(spark.createDataFrame(rows, kind), catalogue).collect()} == {"one": 1, "whole": 2}


def test_support_from_the_other_title_isn_t_lost(spark):
    cols = EVENT + ", support array<string>, doors int"
    rows = [event(1, city=None, title="Coilguns (extra)") + ([], 1170), event(2, city=None, title="COILGUNS + Haatdrager (NL) + Coilguns", time=1230) + (None, None)]
    got = {r.id: (r.support, r.doors, r.merged) for r in R.merge_same_evening(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"e1": (["Haatdrager"], 1170, 1)}


def test_containing_joins_by_pieces(spark):
    texts = spark.createDataFrame([(1, "the quick fox"), (2, "ab"), (3, ""), (4, None)], "id int, text string")
    words = spark.createDataFrame([("quick",), ("x",), ("ab",), ("he q",), ("",), ("zebra",), ("abc",)], "word string")
    assert sorted((r.id, r.word) for r in R.containing(texts, "text", words, "word").collect()) == [(1, "he q"), (1, "quick"), (1, "x"), (2, "ab")]
