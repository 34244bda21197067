"""Queries of the nightly build over the driver tables: keys, cleaning, classification, resolution, state, audit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import keys as K
from ..operators import audit as U
from ..operators import classify as C
from ..operators import clean as L
from ..operators import resolve as R
from ..operators import state as S
from .binding import AGENDA_SQL, TODAY, agenda, table

W = f"WITH {AGENDA_SQL}"
HHMM = lambda c: F.concat(F.lpad(F.floor(c / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((c % 60).cast("string"), 2, "0"))
HHMM_SQL = "concat(lpad(CAST(time // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(time % 60 AS VARCHAR), 2, '0'))"


@query("k01_keys", """SELECT p_partkey, left(trim(regexp_replace(lower(concat(p_name, ' & ', p_brand)), '[^a-z0-9]+', '-', 'g'), '-'), 48) AS slug, left(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), 14) AS norm14,
    regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS artist, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS first_act, concat(p_name, '|', p_brand) AS venue_group_raw FROM part""")
def k01(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    marked = F.translate("p_name", "eo", "éö")
    return p.select("p_partkey", K.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"), K.norm14("p_name").alias("norm14"), K.artist_key(marked).alias("artist"), K.first_act(F.concat("p_name", F.lit(" (2e zaal) + Support"))).alias("first_act"), F.concat_ws("|", "p_name", "p_brand").alias("venue_group_raw"))


@query("k12_event_ids", f"""{W}, s AS (SELECT ord, venue, date, title, time, vtype, {HHMM_SQL} AS clock FROM agenda), b AS (SELECT *, concat(venue, '|', strftime(date, '%Y-%m-%d'), '|', title, CASE WHEN vtype = 'film' THEN concat('|', clock) ELSE '' END) AS k FROM s),
    f AS (SELECT *, first_value(clock) OVER (PARTITION BY k ORDER BY ord) AS fc, row_number() OVER (PARTITION BY k ORDER BY ord) AS r FROM b), i AS (SELECT *, concat('s', left(sha1(CASE WHEN r > 1 AND clock <> fc THEN concat(k, '|', clock) ELSE k END), 10)) AS id FROM f)
    SELECT id, min(ord) AS ord, arg_max(clock, ord) AS clock FROM i GROUP BY id""")
def k12(spark, sf_dir):
    rows = agenda(spark, sf_dir).select("ord", F.col("venue").alias("source"), F.col("date"), "title", HHMM(F.col("time")).alias("time"), "vtype", "end")
    return R.assign_ids(rows).select("id", "ord", F.col("time").alias("clock"))


def dirty(spark, sf_dir) -> DataFrame:
    o = F.col("ord")
    a = agenda(spark, sf_dir)
    return a.select(
        "ord", F.when(o % 101 == 0, "bad id!").otherwise(F.col("id")).alias("id"), F.when(o % 97 == 0, "?").otherwise(F.col("v").cast("string")).alias("v"), F.when(o % 89 == 0, F.lit("\x00 \x07")).otherwise(F.concat(F.lit("  "), "title", F.lit("\t x"))).alias("title"),
        F.when(o % 83 == 0, "2024-02-31").when(o % 79 == 0, "2024-2-3").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"), F.when(o % 13 == 0, "24:10").otherwise(HHMM(F.col("time"))).alias("time"), F.when(o % 7 == 0, "javascript:x").otherwise(F.col("url")).alias("url"), F.when(o % 5 == 0, None).otherwise(F.col("genre")).alias("genre"), F.when(o % 19 == 0, -1 - F.col("price")).otherwise(F.col("price")).alias("price"), "status", F.date_format("end", "yyyy-MM-dd").alias("end"), F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"),
    )


def _cleaned(spark, sf_dir) -> DataFrame:
    return L.clean_events(dirty(spark, sf_dir), agenda(spark, sf_dir).where("v % 10 <> 3").select("v"), TODAY)


_CLEAN = f"""{W}, c AS (SELECT *, CASE WHEN ord % 101 = 0 THEN 'id' WHEN ord % 97 = 0 THEN 'podium-id' WHEN ord % 89 = 0 THEN 'titel' WHEN ord % 83 = 0 OR ord % 79 = 0 THEN 'datum' WHEN v % 10 = 3 THEN 'onbekend podium' END AS reason FROM agenda)"""


@query("f06_clean_events", f"""{_CLEAN} SELECT ord, reason, CASE WHEN ord % 89 <> 0 THEN concat(title, ' x') END AS title, CASE WHEN ord % 13 <> 0 THEN {HHMM_SQL} END AS time, CASE WHEN ord % 7 = 0 THEN '' ELSE url END AS url, CASE WHEN ord % 5 = 0 THEN 'Overig' ELSE genre END AS genre,
    CASE WHEN ord % 19 <> 0 THEN price END AS price, status, CASE WHEN ord % 83 <> 0 AND ord % 79 <> 0 THEN "end" END AS "end" FROM c""")
def f06(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("ord", "reason", "title", "time", "url", "genre", "price", "status", "end")


@query("a03_reject_counts", f"{_CLEAN} SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY reason")
def a03(spark, sf_dir):
    return L.reject_report(_cleaned(spark, sf_dir))


@query("t08_publication_gate", f"{_CLEAN} SELECT count(*) AS n_in, count_if(reason IS NULL) AS n_out, CASE WHEN count_if(reason IS NULL) = 0 THEN 'leeg' WHEN count_if(reason IS NOT NULL) > 0.03 * count(*) THEN 'te veel afgekeurd' ELSE 'ok' END AS verdict FROM c")
def t08(spark, sf_dir):
    return S.gate(_cleaned(spark, sf_dir), 100)


@query("f07_used_venues", f"{W} SELECT DISTINCT v FROM agenda")
def f07(spark, sf_dir):
    from .binding import venues

    return L.used_venues(venues(spark, sf_dir), agenda(spark, sf_dir)).select("v")


@query("f08_known_others", f"{W} SELECT ord, CASE WHEN (v + 3) % 10 <> 4 AND v + 3 IN (SELECT c_custkey FROM customer) THEN CAST(v + 3 AS VARCHAR) END AS others FROM agenda")
def f08(spark, sf_dir):
    a = agenda(spark, sf_dir).select("ord", "id", F.col("v").cast("string").alias("v"), F.array(F.struct((F.col("v") + 3).cast("string").alias("v"), F.lit("").alias("url")), F.struct(F.col("v").cast("string").alias("v"), F.lit("").alias("url"))).alias("ook"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 4").select(F.col("c_custkey").cast("string").alias("v"))
    return L.known_others(a, known).select("ord", F.array_join("ook.v", ",").alias("others"))


@query("f04_horizon", f"{W} SELECT id FROM agenda WHERE coalesce(\"end\", date) >= DATE '{TODAY}' AND date_diff('day', DATE '{TODAY}', date) <= CASE WHEN vtype IN ('festival', 'museum') THEN 400 WHEN vtype = 'film' THEN 10 ELSE 240 END")
def f04(spark, sf_dir):
    return L.horizon(agenda(spark, sf_dir), TODAY).select("id")


@query("f03_tidy", f"""{W} SELECT ord, CASE WHEN ord % 4 = 0 THEN 'sold' ELSE status END AS status, CASE WHEN ord % 4 = 1 THEN concat(title, ' & co') ELSE title END AS title,
    CASE WHEN vtype <> 'film' AND time < 540 AND (time % 15 <> 0 OR vtype = 'museum' OR time BETWEEN 180 AND 359) THEN NULL ELSE {HHMM_SQL} END AS time,
    CASE WHEN vtype NOT IN ('festival', 'museum') AND coalesce(NOT (vtype <> 'film' AND time < 540 AND (time % 15 <> 0 OR time BETWEEN 180 AND 359)) AND time >= 1020, false) AND date_diff('day', date, "end") = 1 THEN NULL WHEN vtype IN ('pop', 'thea') AND date_diff('day', date, "end") > 31 THEN NULL ELSE "end" END AS "end" FROM agenda WHERE ord % 4 <> 3""")
def f03(spark, sf_dir):
    o = F.col("ord")
    t = F.when(o % 4 == 0, F.concat("title", F.lit(" * Uitverkocht *"))).when(o % 4 == 1, F.concat("title", F.lit(" &amp;amp; co tickets kopen? Nu"))).when(o % 4 == 2, F.col("title")).otherwise("Laatste kaarten")
    rows = agenda(spark, sf_dir).withColumns({"title": t, "time": HHMM(F.col("time"))})
    return L.tidy(rows).select("ord", "status", "title", "time", "end")


#: Titles with a known class, from the part table.
_KIND = {0: ("Filmavond: {}", True, "Film"), 1: ("{} in concert", False, "Klassiek"), 2: ("{} (1993)", True, "Film"), 3: ("{} de musical", False, "Musical"), 4: ("Techno met {}", False, "Dance"), 5: ("Kindervoorstelling {} (4+)", False, "Jeugd"), 6: ("{}", False, None)}


def titled(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = (F.col("p_partkey") % 7).cast("int")
    title = F.coalesce(*(F.when(k == i, F.concat(*(x for a in (t.split("{}")[0],) for x in (F.lit(a), F.col("p_name"), F.lit(t.split("{}")[1]))))) for i, (t, _, _) in _KIND.items()))
    return p.select("p_partkey", F.col("p_partkey").alias("ord"), k.alias("k"), title.alias("title"), F.concat(F.lit("https://x.example/agenda/"), "p_partkey").alias("url"), F.when(F.col("p_size") % 2 == 0, "concert").otherwise("pop").alias("vtype"), F.col("p_brand").alias("venue"), "p_name", "p_size")


@query("c01_is_film", "SELECT p_partkey, p_partkey % 7 IN (0, 2) AS film FROM part")
def c01(spark, sf_dir):
    return titled(spark, sf_dir).select("p_partkey", C.is_film(F.col("title"), F.col("url"), F.col("vtype")).alias("film"))


_DEFAULT = "CASE WHEN p_size % 2 = 0 THEN 'Klassiek' ELSE 'Overig' END"


@query("c02_guess_genre", f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Film' WHEN 2 THEN 'Film' WHEN 3 THEN 'Musical' WHEN 4 THEN 'Dance' WHEN 5 THEN 'Jeugd' WHEN 6 THEN CASE WHEN p_name = 'red widget' THEN 'Rock' ELSE {_DEFAULT} END ELSE {_DEFAULT} END AS genre FROM part""")
def c02(spark, sf_dir):
    dictionary = table(spark, sf_dir, "part").where("p_name = 'red widget'").select(K.artist_key("p_name").alias("key"), F.lit("Rock").alias("genre")).distinct()
    return C.assign_genre(titled(spark, sf_dir), dictionary).select("p_partkey", "genre")


@query("c04_mark_known_films", """WITH r AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, p_brand AS venue, p_partkey % 5 = 0 AS film FROM part)
    SELECT p_partkey, CASE WHEN film OR (key IN (SELECT key FROM r WHERE film AND length(key) >= 4) AND venue IN (SELECT venue FROM r WHERE film)) THEN 'Film' ELSE 'Pop' END AS genre FROM r""")
def c04(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), F.lit("pop").alias("vtype"), F.when(F.col("p_partkey") % 5 == 0, "Film").otherwise("Pop").alias("genre"))
    return C.mark_known_films(p).select("p_partkey", "genre")


@query("c09_genre_worklist", """SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, count(*) AS n, arg_min(p_name, p_partkey) AS example FROM part WHERE p_size % 3 = 0 AND p_name <> 'red widget' GROUP BY 1""")
def c09(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.lit("pop").alias("vtype"), F.when(F.col("p_size") % 3 == 0, "Overig").otherwise("Rock").alias("genre"))
    return C.genre_worklist(rows, p.where("p_name = 'red widget'").select(K.artist_key("p_name").alias("key")).distinct())


@query("c10_listing_genres", "WITH l AS (SELECT l_partkey AS id, arg_min(l_shipdate, l_orderkey * 10 + l_linenumber) AS x, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS g FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT p_partkey AS id, coalesce(g, CASE WHEN p_size % 2 = 0 THEN 'Cabaret' END, 'Overig') AS genre FROM part LEFT JOIN l ON p_partkey = id")
def c10(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "Cabaret").otherwise("Concert").alias("kind"))
    listing = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("genre"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return C.listing_genres(p, listing, {"Cabaret": "Cabaret"}).select("id", "genre")


@query("c05_changed_genres", "WITH a AS (SELECT event_type AS old, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS new FROM events) SELECT old, new, count(*) AS n FROM a WHERE old <> new GROUP BY old, new")
def c05(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("genre"))
    return C.changed_genres(e, e.withColumn("genre", F.when(F.col("id") % 3 == 0, "view").otherwise(F.col("genre"))))


def _hours(spark, sf_dir) -> DataFrame:
    """Agenda with times rounded to half days, so that shows coincide."""
    return agenda(spark, sf_dir).withColumns({"time": (F.col("time") / 360).cast("int") * 360, "venue": F.concat("city", F.lit(" hall"))})


_HOURS = f"{W}, h AS (SELECT * REPLACE (CAST(time // 360 * 360 AS INTEGER) AS time, concat(city, ' hall') AS venue) FROM agenda)"


@query("d01_source_duplicates", f"{_HOURS} SELECT min(ord) AS ord FROM h GROUP BY venue, date, title, CASE WHEN vtype = 'film' THEN time END")
def d01(spark, sf_dir):
    return R.dedupe_source(_hours(spark, sf_dir).withColumn("source", F.col("venue"))).select("ord")


@query("d02_page_duplicates", f"{_HOURS} SELECT min(ord) AS ord FROM h GROUP BY split_part(url, '?', 1), date, time")
def d02(spark, sf_dir):
    return R.dedupe_pages(_hours(spark, sf_dir)).select("ord")


@query("d03_show_duplicates", f"{_HOURS}, r AS (SELECT ord, vtype, row_number() OVER (PARTITION BY venue, date, time, replace(lower(title), ' ', '') ORDER BY ord) AS rn FROM h) SELECT ord FROM r WHERE rn = 1 OR vtype = 'film'")
def d03(spark, sf_dir):
    return R.dedupe_shows(_hours(spark, sf_dir)).select("ord")


@query("d04_same_evening")
def d04(spark, sf_dir):
    return R.merge_same_evening(_hours(spark, sf_dir)).select("id", "merged", "time", "price")


@query("d04b_same_evening_support", f"""{W} SELECT id, 1 AS merged, array_to_string(['CARNE'], ',') AS support, ord % 1000 AS doors FROM agenda WHERE vtype NOT IN ('film', 'festival')""")
def d04b(spark, sf_dir):
    """Every evening stands on two sites: the hall's with the doors, the other with the support act in its title, some without a city."""
    k = F.col("ord")
    act = F.concat(F.lit("Carsick "), k.cast("string"))
    first = agenda(spark, sf_dir).where("vtype not in ('film', 'festival')").withColumns({"title": act, "url": F.lit("https://hall.example/x"), "end": F.lit(None).cast("date"), "genre": F.lit("Pop"), "doors": (k % 1000).cast("int"), "support": F.array().cast("array<string>"), "city": F.when(k % 3 != 0, F.col("city"))})
    second = first.withColumns({"id": F.concat(F.lit("x"), "id"), "title": F.concat(F.upper(act), F.lit(" + CARNE (BE)")), "url": F.lit("https://www.other.example/y"), "doors": F.lit(None).cast("int"), "time": F.col("time") + 100, "price": F.lit(None).cast("double")})
    return R.merge_same_evening(first.unionByName(second)).select("id", "merged", F.array_join("support", ",").alias("support"), "doors")


@query("d05_multi_venue")
def d05(spark, sf_dir):
    rows = agenda(spark, sf_dir).withColumns({"time": (F.col("time") / 360).cast("int") * 360, "title": F.concat("title", F.lit(" big band night"), F.when(F.col("ord") % 2 == 0, " extra").otherwise("")), "vtype": F.when(F.col("vtype") == "film", "cafe").otherwise(F.col("vtype"))})
    out = R.merge_multi_venue(rows)
    return out.select("id", "first_seen", "price", F.size(F.coalesce("ook", F.array())).alias("others"))


@query("a02_series_ends", f"""{W}, x AS (SELECT *, CASE WHEN ord % 7 < 3 THEN DATE '2024-03-01' + CAST(ord % 3 AS INTEGER) END AS e2 FROM agenda), s AS (SELECT venue, e2, count(DISTINCT date) AS n FROM x WHERE vtype NOT IN ('museum', 'festival') GROUP BY 1, 2)
    SELECT x.ord, CASE WHEN x.vtype NOT IN ('museum', 'festival') AND coalesce(s.n, 0) >= 3 THEN NULL ELSE x.e2 END AS "end" FROM x LEFT JOIN s ON x.venue = s.venue AND x.e2 = s.e2""")
def a02(spark, sf_dir):
    rows = agenda(spark, sf_dir).withColumn("end", F.when(F.col("ord") % 7 < 3, F.date_add(F.lit("2024-03-01").cast("date"), (F.col("ord") % 3).cast("int"))))
    return R.fix_series_ends(rows).select("ord", "end")


@query("j02_first_seen", f"""{W}, p AS (SELECT * FROM agenda WHERE ord % 3 = 0), i AS (SELECT id, min(first_seen) AS a FROM p GROUP BY id), g AS (SELECT venue, split_part(url, '?', 1) AS page, date, min(first_seen) AS b FROM p GROUP BY 1, 2, 3)
    SELECT agenda.ord, coalesce(a, b, DATE '{TODAY}') AS first_seen FROM agenda LEFT JOIN i ON agenda.id = i.id LEFT JOIN g ON agenda.venue = g.venue AND split_part(agenda.url, '?', 1) = g.page AND agenda.date = g.date""")
def j02(spark, sf_dir):
    a = agenda(spark, sf_dir)
    return R.first_seen(a, a.where("ord % 3 = 0"), TODAY).select("ord", "first_seen")


@query("j03_relocate", f"""{W}, e AS (SELECT *, CASE WHEN ord % 4 = 0 THEN concat('Supplier#', lpad(CAST(ord % 100 AS VARCHAR), 9, '0')) END AS loc FROM agenda), s AS (SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT ord, coalesce(s_name, venue) AS venue FROM e LEFT JOIN s ON n_name = city AND s_name = loc AND vtype NOT IN ('film', 'festival')""")
def j03(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    sources = s.select(F.col("s_name").alias("name"), "city", F.lit("P").alias("prov"), F.lit("pop").alias("type"), F.col("s_suppkey").alias("place"))
    e = agenda(spark, sf_dir).withColumn("loc", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("Supplier#"), F.lpad((F.col("ord") % 100).cast("string"), 9, "0"))))
    return R.relocate(e, sources).select("ord", "venue")


@query("j04_supplement", f"""{W}, p AS (SELECT * FROM agenda WHERE ord % 2 = 0), s AS (SELECT * FROM agenda WHERE ord % 2 = 1) SELECT ord FROM p UNION ALL SELECT s.ord FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.venue = s.venue AND p.date = s.date AND p.title = s.title)""")
def j04(spark, sf_dir):
    a = agenda(spark, sf_dir)
    return R.supplement(a.where("ord % 2 = 0"), a.where("ord % 2 = 1")).select("ord")


@query("j05_venue_dimension", f"{W} SELECT left(trim(regexp_replace(lower(concat(venue, '-', city)), '[^a-z0-9]+', '-', 'g'), '-'), 48) AS vid, arg_min(vtype, ord) AS vtype, min(CASE WHEN v % 3 <> 0 THEN round(lat, 5) END) AS lat FROM agenda GROUP BY 1")
def j05(spark, sf_dir):
    from .binding import venues

    cache = venues(spark, sf_dir).where("v % 3 <> 0").select("venue", "city", F.round("lat", 5).alias("lat"), "lon")
    return R.venue_dimension(agenda(spark, sf_dir).drop("lat", "lon"), cache).select("vid", "vtype", "lat")


@query("j06_match_alerts", f"""{W}, h AS (SELECT id, concat('artiest: ', 'Act ', p_size) AS reason, 1 AS rank FROM agenda JOIN (SELECT DISTINCT p_size FROM part WHERE p_brand = 'Brand#3') p ON regexp_replace(lower(title), '[^a-z0-9]', '', 'g') = concat('act', p_size)
    UNION ALL SELECT id, concat('podium: ', s.c_name), 2 FROM agenda JOIN (SELECT c_name FROM customer WHERE c_custkey % 10 = 1) s ON lower(venue) = lower(s.c_name) UNION ALL SELECT id, 'alarm: ct 7', 3 FROM agenda WHERE contains(lower(title), 'ct 7'))
    SELECT id, reason, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, reason) AS r FROM h) x WHERE r = 1""")
def j06(spark, sf_dir):
    artists = table(spark, sf_dir, "part").where("p_brand = 'Brand#3'").select(F.concat_ws(" ", F.lit("Act"), F.col("p_size").cast("string")).alias("name")).distinct()
    venues = table(spark, sf_dir, "customer").where("c_custkey % 10 = 1").select(F.col("c_name").alias("name"))
    words = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("ct 7").alias("word"))
    return R.match_alerts(agenda(spark, sf_dir), artists, venues, words)


@query("j08_resolve_artists", """WITH c AS (SELECT p_name, p_partkey, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_size >= 20),
    b AS (SELECT p_name, p_partkey FROM c WHERE r = 1), n AS (SELECT DISTINCT p_name FROM part)
    SELECT concat(p_name, '!') AS key, p_partkey AS artist_id FROM b
    UNION ALL SELECT concat(p_name, ': nobody'), p_partkey FROM b""")
def j08(spark, sf_dir):
    """Whole names, names with an artist on one side of a colon, and names with one on both sides, which stay open."""
    p = table(spark, sf_dir, "part")
    item = lambda name, part: F.struct(name.alias("name"), F.lit(20).alias("least"), F.lit(part).alias("part"), F.lit(False).alias("unknown_ok"))
    the, nobody = F.concat(F.lit("The "), F.upper("p_name")), F.lit("nobody at all")
    names = p.select("p_name").distinct()
    kinds = (("!", F.array(item(nobody, False), item(the, False))), (": nobody", F.array(item(nobody, False), item(the, True), item(nobody, True))), (": both", F.array(item(nobody, False), item(the, True), item(F.upper("p_name"), True))))
    artists = None
    for end, variants in kinds:
        one = names.select(F.concat("p_name", F.lit(end)).alias("key"), variants.alias("variants"))
        artists = one if artists is None else artists.union(one)
    catalogue = p.select(F.col("p_partkey").alias("artist_id"), F.col("p_name").alias("name"), F.col("p_size").alias("popularity"))
    return R.resolve_artists(artists, catalogue)


@query("j09_publish_matches", """SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN p_partkey + 7 WHEN p_partkey % 3 = 0 THEN p_partkey WHEN p_partkey % 4 = 0 THEN NULL END AS artist_id,
    CASE WHEN p_partkey % 5 = 0 THEN 'skip' WHEN p_partkey % 5 = 1 OR p_partkey % 3 = 0 THEN 'found' WHEN p_partkey % 4 = 0 AND p_partkey % 7 > 1 THEN 'none' ELSE 'pending' END AS state FROM part""")
def j09(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("A"), "p_name", F.lit(" feat. B"))).when(k % 7 == 1, F.rpad("p_name", 41, "x")).otherwise(F.left("p_name", F.lit(20)))
    p = table(spark, sf_dir, "part").select(k.alias("key"), "p_partkey", F.regexp_replace(name, ",", "").alias("name"))
    found = p.where(k % 3 == 0).select("key", k.alias("artist_id"))
    cache = p.where(k % 4 == 0).select("key", F.lit(None).cast("bigint").alias("artist_id"))
    over = p.where(k % 5 < 2).select("key", F.when(k % 5 == 1, k + 7).alias("artist_id"), (k % 5 == 0).alias("skip"))
    return R.publish_matches(p.select("key", "name"), found, cache, over)


@query("a05_artists", f"{W} SELECT regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key, arg_min(title, ord) AS name, min(date) AS first_date FROM agenda GROUP BY 1")
def a05(spark, sf_dir):
    return S.artists(agenda(spark, sf_dir))


def _counts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("source"), "o_orderdate", "o_orderkey")
    before = o.groupBy("source").agg(F.count("*").cast("int").alias("n"))
    now = o.where("source % 4 <> 0 and (source % 4 <> 1 or o_orderkey % 9 = 0)").groupBy("source").agg(F.count("*").cast("int").alias("n"))
    status = before.select("source", F.date_sub(F.lit(TODAY).cast("date"), (F.col("source") % 10).cast("int")).alias("ok"), "n").where("source % 3 = 0")
    return status, before, now


@query("t01_safety_net", f"""WITH o AS (SELECT o_custkey % 300 AS source, o_orderkey FROM orders), b AS (SELECT source, count(*) AS before FROM o GROUP BY 1), n AS (SELECT source, count(*) AS now FROM o WHERE source % 4 <> 0 AND (source % 4 <> 1 OR o_orderkey % 9 = 0) GROUP BY 1),
    j AS (SELECT b.source, before, coalesce(now, 0) AS now, CASE WHEN b.source % 3 = 0 THEN DATE '{TODAY}' - CAST(b.source % 10 AS INTEGER) ELSE DATE '{TODAY}' END AS ok FROM b LEFT JOIN n ON b.source = n.source), s AS (SELECT *, before >= 6 AND (now = 0 OR (before >= 20 AND now < before * 0.25)) AS silent FROM j)
    SELECT source, CASE WHEN NOT silent THEN 'ok' WHEN date_diff('day', ok, DATE '{TODAY}') < 7 THEN 'houd' ELSE 'vervallen' END AS verdict, CASE WHEN silent THEN ok ELSE DATE '{TODAY}' END AS ok, CASE WHEN silent THEN before ELSE now END AS n FROM s""")
def t01(spark, sf_dir):
    return S.source_safety_net(*_counts(spark, sf_dir), TODAY)


@query("t02_carried", f"""WITH v AS (SELECT source, verdict FROM (WITH o AS (SELECT o_custkey % 300 AS source, o_orderkey FROM orders), b AS (SELECT source, count(*) AS before FROM o GROUP BY 1), n AS (SELECT source, count(*) AS now FROM o WHERE source % 4 <> 0 AND (source % 4 <> 1 OR o_orderkey % 9 = 0) GROUP BY 1)
    SELECT b.source, CASE WHEN NOT (before >= 6 AND (coalesce(now, 0) = 0 OR (before >= 20 AND coalesce(now, 0) < before * 0.25))) THEN 'ok' WHEN b.source % 3 <> 0 OR b.source % 10 < 7 THEN 'houd' ELSE 'vervallen' END AS verdict FROM b LEFT JOIN n ON b.source = n.source) x)
    SELECT o.o_orderkey, o.stale FROM (SELECT o_custkey % 300 AS source, o_orderkey, false AS stale FROM orders WHERE o_custkey % 300 % 4 <> 0 AND (o_custkey % 300 % 4 <> 1 OR o_orderkey % 9 = 0)) o JOIN v ON o.source = v.source WHERE verdict <> 'houd'
    UNION ALL SELECT o_orderkey, true FROM orders JOIN v ON o_custkey % 300 = v.source WHERE verdict = 'houd'""")
def t02(spark, sf_dir):
    status, before, now = _counts(spark, sf_dir)
    verdicts = S.source_safety_net(status, before, now, TODAY)
    old = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("source"), "o_orderkey")
    return S.carry(old.where("source % 4 <> 0 and (source % 4 <> 1 or o_orderkey % 9 = 0)"), old, verdicts).select("o_orderkey", "stale")


@query("t04_not_sent", f"{W} SELECT id FROM agenda WHERE NOT (ord % 3 = 0 AND ord % 100 <= 60)")
def t04(spark, sf_dir):
    sent = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"), F.date_sub(F.lit(TODAY).cast("date"), (F.col("event_id") % 100).cast("int")).alias("date"))
    return S.not_sent(agenda(spark, sf_dir), sent, TODAY).select("id")


@query("t05_refetch_worklist", "SELECT o_orderkey AS url FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 12 > 7 OR (o_orderkey % 30 <= 14 AND o_orderkey % 12 > 0)")
def t05(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    t = F.lit(TODAY).cast("date")
    cache = o.where(k % 4 != 0).select(k.alias("url"), F.date_sub(t, (k % 12).cast("int")).alias("at"), F.when(k % 5 == 0, 1).otherwise(2).alias("v"), F.date_add(t, (k % 30).cast("int")).alias("next_date"))
    return S.refetch_worklist(o.select(k.alias("url")), cache, TODAY, 2)


@query("t06_lookup_worklist", "SELECT p_partkey AS key FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 50 >= 30) ORDER BY p_size, p_partkey LIMIT 500")
def t06(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    cache = p.where(k % 3 != 0).select(k.alias("key"), F.when(k % 3 == 2, k).alias("artist_id"), F.date_sub(F.lit(TODAY).cast("date"), (k % 50).cast("int")).alias("t"))
    return S.lookup_worklist(p.select(k.alias("key"), F.col("p_size").alias("first_date")), cache, TODAY, budget=500).select("key")


@query("s03_handover", f"SELECT o_orderkey FROM orders WHERE o_custkey % 30 <= 21 AND CAST(o_orderdate AS DATE) >= DATE '1995-06-01' AND o_custkey % 50 IN (SELECT o_custkey % 50 FROM orders GROUP BY 1 HAVING count(*) <= 5000)")
def s03(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("source"), F.date_sub(F.lit("1995-06-01").cast("date"), (F.col("o_custkey") % 30).cast("int")).alias("handed"), F.to_date("o_orderdate").alias("date"), F.lit(None).cast("date").alias("end"))
    return S.accept_handover(o, "1995-06-01").select("o_orderkey")


@query("s12_older_snapshot", f"SELECT event_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '{TODAY}') >= 6)")
def s12(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("snapshot_date", F.to_date("ts"))
    return S.snapshot_before(e, TODAY).select("event_id")


@query("q23_alert_digest", f"{W}, h AS (SELECT ord, title FROM agenda WHERE status = 'sold'), n AS (SELECT count(*) AS n FROM h) SELECT title AS message, 1 AS n FROM h, n WHERE n <= 8 UNION ALL SELECT string_agg(title, chr(10) ORDER BY ord) AS message, any_value(n) AS n FROM (SELECT h.*, n FROM h, n WHERE n > 8 ORDER BY ord LIMIT 15) x HAVING count(*) > 0")
def q23(spark, sf_dir):
    h = agenda(spark, sf_dir).where("status = 'sold'").select("id", "ord", F.col("title").alias("line"))
    return S.alert_digest(h)


_AUDIT = f"""{W}, a AS (SELECT * FROM agenda),
 c1 AS (SELECT 'crowded_slots' AS "check", venue AS subject, count(*) AS n, EXAMPLES(CAST(date AS VARCHAR)) FROM (SELECT venue, date, time FROM a WHERE vtype NOT IN ('film', 'festival') GROUP BY 1, 2, 3 HAVING count(*) > 3) x GROUP BY 2),
 c2 AS (SELECT 'far_dates' AS "check", venue, count(*), EXAMPLES(title) FROM a WHERE date_diff('day', DATE '{TODAY}', date) > 15 GROUP BY 2), c3 AS (SELECT 'long_periods' AS "check", venue, count(*), EXAMPLES(title) FROM a WHERE vtype NOT IN ('festival', 'museum') AND date_diff('day', date, "end") > 31 GROUP BY 2),
 c4 AS (SELECT 'odd_times' AS "check", venue, count(*), EXAMPLES(title) FROM a WHERE time < 540 GROUP BY 2), c5 AS (SELECT 'duplicates' AS "check", venue, count(*), EXAMPLES(title) FROM (SELECT venue, date, time, title FROM a GROUP BY 1, 2, 3, 4 HAVING count(*) > 1) x GROUP BY 2)"""
_AUDIT = re.sub(r"EXAMPLES\((.*?\)?)\)", r"array_to_string(list_slice(list_sort(list_distinct(list(\1))), 1, 3), '; ') AS examples", _AUDIT)


@query("a20_audit", f'{_AUDIT} SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4 UNION ALL SELECT * FROM c5')
def a20(spark, sf_dir):
    a = agenda(spark, sf_dir)
    out = U.crowded_slots(a).unionByName(U.far_dates(a, TODAY, 15)).unionByName(U.long_periods(a)).unionByName(U.odd_times(a)).unionByName(U.duplicates(a))
    return out


@query("s11b_report_cut", f"""{_AUDIT}, c AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4 UNION ALL SELECT * FROM c5),
    r AS (SELECT *, list_position(['crowded_slots', 'odd_times', 'far_dates', 'duplicates', 'long_periods'], "check") AS s, row_number() OVER (PARTITION BY "check" ORDER BY n DESC, subject) AS r, count(*) OVER (PARTITION BY "check") AS k FROM c),
    l AS (SELECT DISTINCT s, 0 AS r, concat('### ', "check", ' (', k, ')') AS line FROM r UNION ALL SELECT s, r, concat('- ', subject, ': ', n, '×', CASE WHEN examples <> '' THEN concat(', bv. ', examples) ELSE '' END) FROM r WHERE r <= 15
        UNION ALL SELECT DISTINCT s, 16, concat('- … en nog ', k - 15) FROM r WHERE k > 15 UNION ALL SELECT DISTINCT s, 17, '' FROM r),
    t AS (SELECT string_agg(line, chr(10) ORDER BY s, r) AS t FROM l)
    SELECT CASE WHEN length(t) > 1500 THEN concat(left(t, 1500), chr(10), chr(10), '… (afgekapt)') ELSE t END AS report, length(t) AS n_chars FROM t""")
def s11b(spark, sf_dir):
    return U.report(a20(spark, sf_dir), ("crowded_slots", "odd_times", "far_dates", "duplicates", "long_periods"), most=1500)


@query("a24_mostly_sold", f"{W}, x AS (SELECT venue, v % 4 = 0 AND ord % 3 <> 0 AS sold FROM agenda) SELECT venue AS subject, count_if(sold) AS n FROM x GROUP BY venue HAVING count(*) >= 5 AND count_if(sold) > 0.6 * count(*)")
def a24(spark, sf_dir):
    return U.mostly_sold(agenda(spark, sf_dir).withColumn("status", F.when((F.col("v") % 4 == 0) & (F.col("ord") % 3 != 0), "sold"))).select("subject", "n")


@query("a21_sharp_drops", "WITH b AS (SELECT o_custkey AS s, count(*) AS was, count_if(o_orderkey % 4 = 0) AS n FROM orders GROUP BY 1) SELECT s AS subject, n FROM b WHERE was >= 6 AND n > 0 AND n < was * 0.5")
def a21(spark, sf_dir):
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("previous"), F.count_if(F.col("o_orderkey") % 4 == 0).alias("n"))
    return U.sharp_drops(b).select("subject", "n")


@query("a01_source_report", "SELECT user_id AS source, count(*) AS items, count_if(event_type = 'view') AS ok, count_if(event_type = 'error') AS refused FROM events GROUP BY 1")
def a01(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "error", 403).otherwise(301).alias("code"))
    r = U.source_report(e.select("source"), e)
    n = lambda c: F.coalesce(F.try_element_at("codes", F.lit(c)), F.lit(0)).cast("bigint")
    return r.select("source", "items", n("200").alias("ok"), n("403").alias("refused"))


@query("a04_completeness", f"{W} SELECT count(*) AS n, count_if(time < 540) AS early, count(DISTINCT city) AS cities FROM agenda")
def a04(spark, sf_dir):
    return agenda(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("time") < 540).alias("early"), F.countDistinct("city").alias("cities"))


@query("s11_audit_report", f"""{W}, c AS (SELECT venue, count(*) AS n FROM agenda WHERE time < 540 GROUP BY 1), r AS (SELECT venue, n, row_number() OVER (ORDER BY n DESC, venue) AS r FROM c) SELECT 'odd_times' AS "check", concat('## odd_times', chr(10), string_agg(concat('- ', venue, ': ', n), chr(10) ORDER BY r)) AS section FROM r WHERE r <= 15""")
def s11(spark, sf_dir):
    return U.markdown(U.odd_times(agenda(spark, sf_dir)).withColumn("examples", F.lit("")))
