"""Queries of evenings, screenings and follows over the agenda."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import agenda as A
from ..operators import evenings as V
from .agenda_queries import W, _NIGHT, enriched
from .binding import HOME, table


@query("q05c_running_periods", f"{W} SELECT id, car, d FROM enriched WHERE type IN ('expo', 'fest', 'thea') AND end_d IS NOT NULL AND d <= 4 AND end_d >= 2 AND car <= 90")
def q05c(spark, sf_dir):
    return V.running_periods(enriched(spark, sf_dir), 2, 4, 90, ("expo", "fest", "thea")).select("id", "car", "d")


@query("q13b_city_at", f"{_NIGHT}, h AS (SELECT city, id, b, row_number() OVER (PARTITION BY city ORDER BY b, ord) AS place FROM n WHERE time IS NOT NULL AND evening = 1 AND b + 120 > 1230 AND b <= 1290) SELECT city, id, place, b <= 1230 AS busy FROM h WHERE place <= 40")
def q13b(spark, sf_dir):
    return V.city_at(enriched(spark, sf_dir), 1, 1230)


@query("q12b_film_screenings", f"""{W}, f AS (SELECT *, lower(concat_ws('|', venue, city)) AS g FROM enriched WHERE type = 'film' AND time IS NOT NULL AND end_d IS NULL),
    h AS (SELECT ak, d, g, array_to_string(list(concat(time, ' ', id, CASE WHEN d = 0 AND time <= 1140 THEN ' past' ELSE '' END, CASE WHEN status = 'sold' THEN ' sold' ELSE '' END) ORDER BY time, id), ',') AS times, min(coalesce(car, 999)) AS car, min(time) AS t, any_value(venue) AS venue, any_value(city) AS city FROM f GROUP BY ak, d, g),
    n AS (SELECT ak, arg_min(title, length(title) * 1000000) AS title FROM (SELECT ak, title FROM f ORDER BY length(title), title) x GROUP BY ak)
    SELECT h.ak, title, d, row_number() OVER (PARTITION BY h.ak, d ORDER BY car, t, g) AS place, count(*) OVER (PARTITION BY h.ak, d) AS cinemas, venue, city, car, times FROM h JOIN n ON h.ak = n.ak""")
def q12b(spark, sf_dir):
    flag = lambda c, word: F.when(c, F.lit(f" {word}")).otherwise("")
    times = F.array_join(F.transform("times", lambda x: F.concat(x["time"].cast("string"), F.lit(" "), x["id"], flag(x["past"], "past"), flag(x["sold"], "sold"))), ",")
    return V.film_screenings(enriched(spark, sf_dir), 1140).withColumn("times", times)


@query("q15b_following", f"""{W}, a AS (SELECT DISTINCT concat('act', p_size) AS ak FROM part WHERE p_brand = 'Brand#1'), v AS (SELECT DISTINCT lower(concat_ws('|', venue, city)) AS g FROM enriched WHERE v % 40 = 3),
    f AS (SELECT id, age <= 7 AS new, ak IN (SELECT ak FROM a) AS artist, lower(concat_ws('|', venue, city)) IN (SELECT g FROM v) AS at_venue, lower(concat_ws(' ', title, venue, city)) AS s FROM enriched),
    w AS (SELECT *, CASE WHEN contains(s, 'nation_12') THEN 'NATION_12' WHEN contains(s, 'act 3') THEN 'Act 3' WHEN contains(s, '#000000077') THEN '#000000077' END AS alarm FROM f)
    SELECT id, artist, at_venue, alarm, new FROM w WHERE artist OR at_venue OR alarm IS NOT NULL""")
def q15b(spark, sf_dir):
    e = enriched(spark, sf_dir)
    liked = table(spark, sf_dir, "part").where("p_brand = 'Brand#1'").select(F.concat(F.lit("act"), F.col("p_size").cast("string")).alias("ak"))
    halls = e.where("v % 40 = 3").select(F.lower(F.concat_ws("|", "venue", "city")).alias("g"))
    words = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.element_at(F.array(F.lit("NATION_12"), F.lit("Act 3"), F.lit("#000000077")), F.col("r_regionkey").cast("int") + 1).alias("word"), F.col("r_regionkey").alias("place"))
    return V.following(e, liked, halls, words)


@query("o02b_orders", f"{W} SELECT id, row_number() OVER (PARTITION BY city ORDER BY coalesce(car, 999), d, ord) AS near, row_number() OVER (PARTITION BY city ORDER BY venue, d, ord) AS by_venue FROM enriched")
def o02b(spark, sf_dir):
    """All events in the order of distance and of venue, within each city."""
    e = enriched(spark, sf_dir)
    own = F.lit(False)
    out = V.ranked_within(e, ["city"], [*A.agenda_order(own, "near"), F.col("ord")], "near")
    return V.ranked_within(out, ["city"], [*A.agenda_order(own, "venue"), F.col("ord")], "by_venue").select("id", "near", "by_venue")


@query("a10b_dots", f"""{W}, t AS (SELECT v, type, count(*) AS k, any_value(car) AS car, any_value(lat) AS lat, any_value(lon) AS lon FROM enriched GROUP BY v, type), r AS (SELECT v, CAST(sum(k) AS BIGINT) AS n, arg_max(type, k * 1000 + ascii(type) * 1.0 + ascii(substr(type, 2)) / 1000.0) AS main_type, any_value(car) AS car, any_value(lat) AS lat, any_value(lon) AS lon FROM t GROUP BY v),
    b AS (SELECT *, radians(lat) AS p2, radians({HOME[0]}) AS p1, radians(lon) - radians({HOME[1]}) AS dl FROM r WHERE car <= 90), c AS (SELECT *, radians(round(((degrees(atan2(sin(dl) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(dl))) + 360) % 360), 3)) AS w FROM b)
    SELECT v, n, main_type, car, round(car / 90.0 * sin(w), 4) AS x, round(-car / 90.0 * cos(w), 4) AS y, CASE WHEN n >= 10 THEN 3 WHEN n >= 4 THEN 2 ELSE 1 END AS size FROM c""")
def a10b(spark, sf_dir):
    return V.dots(enriched(spark, sf_dir), HOME, 90)
