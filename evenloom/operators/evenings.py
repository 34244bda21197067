"""Lists around an evening: what runs on, a city by the hour, a film's screenings, and what a person follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import artist_key, venue_group
from .agenda import NO_TIME
from .resolve import containing

NO_CAR = 999


def running_periods(df: DataFrame, first: int, last: int, max_car: int, kinds: tuple[str, ...]) -> DataFrame:
    """Events with an end that run on a day from ``first`` to ``last``, within reach: exhibitions and the like. Order: nearest first."""
    return df.where(F.col("type").isin(*kinds) & F.col("end_d").isNotNull() & (F.col("d") <= last) & (F.col("end_d") >= first) & (F.col("car") <= max_car))


def evening_minutes(df: DataFrame, length: int = 120) -> DataFrame:
    """Events with a time as (evening, s, e): before four in the morning belongs to the evening before."""
    early = F.col("time") < 4 * 60
    end = F.coalesce(F.col("end_minute"), F.col("time") + length) if "end_minute" in df.columns else F.col("time") + length
    return df.where("time is not null").withColumns({"evening": F.when(early, F.col("d") - 1).otherwise(F.col("d")), "s": F.when(early, F.col("time") + 1440).otherwise(F.col("time")), "e": F.when(early, end + 1440).otherwise(end)})


def city_at(df: DataFrame, day: int, minute: int, ahead: int = 60, most: int = 40) -> DataFrame:
    """(city, id, place, busy): what runs in each city at a minute of an evening or starts within ``ahead`` minutes, by start;
    ``most`` of a city are listed. busy tells what has begun."""
    rows = evening_minutes(df).where((F.col("evening") == day) & (F.col("e") > minute) & (F.col("s") <= minute + ahead))
    place = F.row_number().over(Window.partitionBy("city").orderBy("s", "ord"))
    return rows.select("city", "id", place.alias("place"), (F.col("s") <= minute).alias("busy")).where(F.col("place") <= most)


def film_screenings(df: DataFrame, now: int) -> DataFrame:
    """(ak, title, d, place, cinemas, venue, city, car, times): each film's days, a row for each cinema of a day, nearest first.

    ``times`` are the day's screenings there by time: (time, id, past, sold). Venue ids of one name and city are one
    cinema. ``title`` is the film's shortest. A cinema shows a film a few times a day, so lists stay short.
    """
    films = df.where("type = 'film' and time is not null and end_d is null").withColumn("g", venue_group("venue", "city"))
    titles = films.groupBy("ak").agg(F.min_by("title", F.struct(F.length("title"), "title")).alias("title"))
    show = F.struct("time", "id", ((F.col("d") == 0) & (F.col("time") <= now)).alias("past"), F.coalesce(F.col("status") == "sold", F.lit(False)).alias("sold"))
    halls = films.groupBy("ak", "d", "g").agg(F.array_sort(F.collect_list(show)).alias("times"), F.min(F.coalesce("car", F.lit(NO_CAR))).alias("car"), F.first("venue").alias("venue"), F.first("city").alias("city"))
    day = Window.partitionBy("ak", "d")
    halls = halls.withColumns({"place": F.row_number().over(day.orderBy("car", F.col("times")[0]["time"], "g")), "cinemas": F.count("*").over(day)})
    return halls.join(titles, "ak").select("ak", "title", "d", "place", "cinemas", "venue", "city", "car", "times")


def following(df: DataFrame, artists: DataFrame, venues: DataFrame, alarms: DataFrame) -> DataFrame:
    """(id, artist, at_venue, alarm, new): events that a person asked for, and why.

    artists(ak) are followed acts, main or support; venues(g) followed venues by name and city; alarms(word, place) words
    in title, venue or city, of which the first by place is named. new: added in the last week.
    """
    support = F.transform(F.col("support"), artist_key) if "support" in df.columns else F.array().cast("array<string>")
    acts = df.select("id", F.explode(F.array_union(F.array("ak"), F.coalesce(support, F.array().cast("array<string>")))).alias("ak"))
    by_act = acts.join(artists.select("ak").distinct(), "ak", "left_semi").select("id").distinct().withColumn("artist", F.lit(True))
    at = df.select("id", venue_group("venue", "city").alias("g")).join(venues.select("g").distinct(), "g", "left_semi").select("id").withColumn("at_venue", F.lit(True))
    said = df.select("id", F.lower(F.concat_ws(" ", "title", "venue", "city")).alias("said"))
    hit = containing(said, "said", alarms.select("word", "place", F.lower("word").alias("low")), "low").groupBy("id").agg(F.min_by("word", "place").alias("alarm"))
    out = df.select("id", (F.col("age") <= 7).alias("new")).join(by_act, "id", "left").join(at, "id", "left").join(hit, "id", "left")
    return out.where("artist or at_venue or alarm is not null").select("id", F.coalesce("artist", F.lit(False)).alias("artist"), F.coalesce("at_venue", F.lit(False)).alias("at_venue"), "alarm", "new")


def dots(df: DataFrame, home: tuple[float, float], max_car: int) -> DataFrame:
    """(v, n, main_type, car, x, y, size): venues within reach on a disc around home: direction by compass, distance by car time."""
    from .agenda import radar

    near = radar(df, home).where(F.col("car") <= max_car)
    angle, reach = F.radians("bearing"), F.col("car") / F.lit(float(max_car))
    return near.select("v", "n", "main_type", "car", F.round(reach * F.sin(angle), 4).alias("x"), F.round(-reach * F.cos(angle), 4).alias("y"), "size")


def ranked_within(df: DataFrame, keys: list[str], order: list, column: str = "place") -> DataFrame:
    """Places in an order within each of ``keys``, so that no task ranks the whole table."""
    return df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def time_order() -> list:
    return [F.coalesce("time", F.lit(NO_TIME)), F.col("ord")]
