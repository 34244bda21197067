"""Agenda queries: enriching events and asking what is on, where, when and how far.

Events have ord, id, v, venue, city, prov, vtype, title, date, time (minutes), genre, price, end, status, first_seen,
url, lat, lon; optional columns (support, ook, doors, start, tot, times, dur) are used where present. ``today`` is
always a parameter. All of it is projections, filters, windows and equi joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing, haversine_km, travel
from ..functions.keys import acts, artist_key, city_key, search_fold, tour_keys, venue_group
from ..functions.urls import let

#: Genres that make a show at a concert venue theatre.
THEATRE_GENRES = ("Cabaret", "Comedy", "Musical", "Toneel", "Dans", "Opera", "Theater", "Jeugd")
NO_TIME = 20 * 60


def has(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def event_type(genre: Column, vtype: Column) -> Column:
    fest = vtype == "festival"
    return (
        F.when((genre == "Film") & ~fest, "film").when((genre == "Tentoonstelling") & ~fest, "expo")
        .when(vtype == "thea", "thea").when(vtype == "film", "film").when(vtype == "museum", "expo").when(fest, "fest")
        .when(genre.isin(*THEATRE_GENRES), "thea").otherwise("pop")
    )


def enrich(events: DataFrame, today: str, home: tuple[float, float] | None = None) -> DataFrame:
    """Events that aren't over, with day numbers, type, acts, search text, age, and travel if a home is given."""
    t = F.lit(today).cast("date")
    support = has(events, "support", "array<string>")
    named = acts(F.col("title"))
    out = events.where(F.coalesce("end", "date") >= t)
    out = out.withColumns({
        "d": F.greatest(F.lit(0), F.datediff("date", t)), "end_d": F.datediff("end", t), "started": F.col("date") < t,
        "type": event_type(F.col("genre"), F.col("vtype")), "artist": named[0],
        "support": F.when(F.size(F.coalesce(support, F.array())) > 0, support).otherwise(F.slice(named, 2, 8)),
        "age": F.coalesce(F.greatest(F.lit(0), F.datediff(t, "first_seen")), F.lit(999)),
    })
    out = out.withColumns({"ak": artist_key("artist"), "hay": search_fold(F.concat_ws(" ", "title", "venue", "city", "genre", F.array_join("support", " "))), "recent": F.col("age") <= 3})
    if home is not None:
        out = with_travel(out, home)
    return out


def with_travel(df: DataFrame, home: tuple[float, float]) -> DataFrame:
    out = df.withColumn("km", haversine_km(home[0], home[1], F.col("lat"), F.col("lon")))
    return out.withColumn("travel", travel(F.col("km"))).withColumn("car", F.col("travel.car"))


def on_day(day: Column | int) -> Column:
    day = day if isinstance(day, Column) else F.lit(day)
    return F.when(F.col("end_d").isNotNull(), (F.col("d") <= day) & (day <= F.col("end_d"))).otherwise(F.col("d") == day)


def in_month(month: str, today: str) -> Column:
    first = F.to_date(F.lit(f"{month}-01"))
    t = F.lit(today).cast("date")
    return (F.col("d") <= F.datediff(F.last_day(first), t)) & (F.coalesce("end_d", "d") >= F.datediff(first, t))


def matches(query: str) -> Column:
    """All words of the query occur in the search text."""
    words = F.filter(F.split(search_fold(F.lit(query)), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.col("hay").contains(w))


def filter_agenda(
    df: DataFrame, today: str, tab: str | None = None, day: int | None = None, month: str | None = None, regions: Sequence[str] = (), venue=None, genres: Sequence[str] = (),
    part_of_day: str | None = None, max_car: int | None = None, free: bool = False, query: str = "", hidden_cities: Sequence[str] = (), hidden_venues: Sequence[str] = (), followed_artists: DataFrame | None = None,
) -> DataFrame:
    """The conditions of the agenda's filters; each is optional. part_of_day is mid, eve or late."""
    conditions = []
    if tab is not None:
        conditions.append(F.col("kids") if tab == "kids" else F.col("type") == tab)
    if day is not None:
        conditions.append(on_day(day))
    elif month is not None:
        conditions.append(in_month(month, today))
    if regions:
        conditions.append(F.col("prov").isin(*regions))
    elsewhere = has(df, "ook", "array<struct<v:string,url:string>>")
    at = None
    if venue is not None:
        at = F.col("v") == venue
        if "ook" in df.columns:
            at = at | F.coalesce(F.exists(elsewhere, lambda o: o["v"] == venue), F.lit(False))
        conditions.append(at)
    if hidden_cities or hidden_venues:
        hidden = city_key("city").isin(*hidden_cities) if hidden_cities else F.lit(False)
        hidden = hidden | (venue_group("venue", "city").isin(*hidden_venues) if hidden_venues else F.lit(False))
        conditions.append(~hidden if at is None else at | ~hidden)
    if genres:
        conditions.append(F.col("genre").isin(*genres))
    if part_of_day is not None:
        conditions.append({"mid": F.col("time") < 1080, "eve": F.col("time").between(1080, 1319), "late": F.col("time") >= 1320}[part_of_day])
    if max_car is not None:
        conditions.append(F.col("car") <= max_car)
    if free:
        conditions.append(F.col("price") == 0)
    if query.strip():
        conditions.append(matches(query))
    for c in conditions:
        df = df.where(c)
    if followed_artists is not None:
        df = followed(df, followed_artists)
    return df


def followed(df: DataFrame, artists: DataFrame) -> DataFrame:
    """Events whose act or support is among artists(ak)."""
    keys = df.select("id", F.explode(F.array_union(F.array("ak"), F.transform(F.col("support"), artist_key))).alias("ak"))
    return df.join(keys.join(artists, "ak", "left_semi").select("id").distinct(), "id", "left_semi")


def agenda_order(own_city: Column, how: str = "date") -> list[Column]:
    car, time = F.coalesce("car", F.lit(999)), F.coalesce("time", F.lit(NO_TIME))
    own = own_city.cast("int").desc()
    return {
        "date": [F.col("started").cast("int").desc(), F.col("d"), own, F.when(F.col("started"), car).otherwise(0), time],
        "az": [own, F.collate("artist", "nl"), F.col("d")],
        "venue": [own, F.collate("venue", "nl"), F.col("d")],
        "near": [car, F.col("d")],
    }[how]


def own_city(home_city: str | None, within_km: float = 5) -> Column:
    return F.col("km") < within_km if home_city is None else city_key("city") == city_key(F.lit(home_city))


def weekend_range(today: Column) -> Column:
    """Day numbers of this weekend: Friday to Sunday, from today if it has begun."""
    wd = F.weekday(today)  # Monday is 0
    return F.struct(F.greatest(F.lit(0), 4 - wd).alias("first"), (6 - wd).alias("last"))


def tonight(df: DataFrame, now: int, max_car: int, days: int = 0) -> DataFrame:
    """Timed events of today (or the next days) within reach that aren't finished, nearest in time first."""
    ends = F.coalesce(F.col("end_minute"), F.col("time") + 120) if "end_minute" in df.columns else F.col("time") + 120
    open_ = ~F.col("started") & F.col("d").between(0, days) & F.col("time").isNotNull() & ((F.col("d") > 0) | (ends > now))
    return df.where(open_ & (F.col("car") <= max_car))


def reachability(df: DataFrame, departure: int, last_departure_margin: int = 10) -> DataFrame:
    """For tonight's events: the margin on arrival and ok, tight, late or missed; the best one of each venue has best."""
    ends = F.col("time") + 120
    margin = F.col("time") - (F.lit(departure) + F.col("car"))
    verdict = F.when(margin >= last_departure_margin, "ok").when(margin >= -10, "tight").when(ends - (departure + F.col("car")) >= 30, "late").otherwise("missed")
    rank = F.when(verdict == "ok", 0).when(verdict == "tight", 1).when(verdict == "late", 2).otherwise(3)
    out = df.where(F.col("time").isNotNull() & F.col("car").isNotNull()).withColumns({"margin": margin, "verdict": verdict, "_rank": rank})
    first = F.row_number().over(Window.partitionBy("v").orderBy("_rank", F.abs("margin"), "ord"))
    return out.withColumn("best", first == 1).drop("_rank")


def last_chance(df: DataFrame, days: int = 14) -> DataFrame:
    return df.where(F.col("end_d").between(0, days))


def similar(df: DataFrame, n: int = 4) -> DataFrame:
    """(id, other): up to n nearest acts of the same type and genre, one event for each act; generic genres have none.

    Acts are reduced to one candidate a (type, genre, act) and to the best n + 1 of a genre before any join, since an
    event's own act is the only one it leaves out.
    """
    few = df.where(~F.col("genre").isin("Overig", "Feest", "Theater"))
    order = [F.coalesce("car", F.lit(999)), F.col("d"), F.col("ord")]
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("type", "genre", "ak").orderBy("ord"))).where("r = 1")
    best = first.withColumn("place", F.row_number().over(Window.partitionBy("type", "genre").orderBy(*order))).where(F.col("place") <= n + 1)
    best = best.select("type", "genre", F.col("ak").alias("other_ak"), F.col("id").alias("other"), "place")
    pairs = few.select("id", "type", "genre", "ak").join(best, ["type", "genre"]).where("ak <> other_ak")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where(F.col("rank") <= n).select("id", "other", "rank")


def same_day_nearby(df: DataFrame, n: int = 4, within: int = 45) -> DataFrame:
    """(id, other, rank): up to n nearest acts of the same type on an event's day, within so many minutes by car.

    Periods count on each of their days. An act is represented by its first event; only the best n + 1 of a type and
    day are joined, since an event's own act is the only one it leaves out.
    """
    near = df.where(F.col("car") <= within).withColumn("day", F.explode(F.sequence(F.col("d"), F.greatest("d", F.coalesce("end_d", "d")))))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("type", "day", "ak").orderBy("ord"))).where("r = 1")
    best = first.withColumn("place", F.row_number().over(Window.partitionBy("type", "day").orderBy("car", F.coalesce("time", F.lit(10_000)), "ord"))).where(F.col("place") <= n + 1)
    best = best.select("type", F.col("day").alias("d"), F.col("ak").alias("other_ak"), F.col("id").alias("other"), "place")
    pairs = df.select("id", "type", "d", "ak").join(best, ["type", "d"]).where("ak <> other_ak")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where(F.col("rank") <= n).select("id", "other", "rank")


def stale(updated: Column, now: Column, hours: int = 36) -> Column:
    """Whether a snapshot's local time of update ("2026-10-09 08:00", Amsterdam) lies over ``hours`` hours before ``now``."""
    at = F.to_utc_timestamp(F.try_to_timestamp(updated, F.lit("yyyy-MM-dd HH:mm")), "Europe/Amsterdam")
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(at) > hours * 3600, F.lit(False))


def tours(df: DataFrame, most: int = 120) -> DataFrame:
    """(id, key) of the keys that two to ``most`` touring events share."""
    able = df.where(F.col("type").isin("pop", "thea") & F.col("end").isNull() & (F.length("ak") >= 4))
    keys = able.select("id", F.explode(tour_keys("title")).alias("key"))
    shared = keys.groupBy("key").agg(F.countDistinct("id").alias("n")).where(F.col("n").between(2, most))
    return keys.join(shared.select("key"), "key", "left_semi")


def tour_dates(df: DataFrame, most: int = 120) -> DataFrame:
    """(id, other, other_car, other_d): other dates of the same act or production, bounded by ``most`` a key."""
    keys = tours(df, most)
    slot = df.select("id", "d", "v", "time", "car")
    other = slot.select(*(F.col(c).alias(f"other_{c}") for c in slot.columns))
    pairs = keys.join(keys.withColumnRenamed("id", "other_id"), "key").where("id <> other_id").select("id", "other_id").distinct()
    pairs = pairs.join(slot, "id").join(other, "other_id")
    same = (F.col("d") == F.col("other_d")) & (F.col("v") == F.col("other_v")) & F.col("time").eqNullSafe(F.col("other_time"))
    return pairs.where(~same).select("id", F.col("other_id").alias("other"), "car", "other_car", "d", "other_d", "v", "other_v", "other_time")


def nearer_date(df: DataFrame, now: int, gain: int = 20, least: int = 30, most: int = 120) -> DataFrame:
    """(id, nearer): the same tour at least ``gain`` minutes closer, where the own venue is ``least`` or more away."""
    pairs = tour_dates(df, most).where((F.col("car") >= least) & (F.col("other_car") <= F.col("car") - gain) & (F.col("v") != F.col("other_v")))
    pairs = pairs.where(~((F.col("other_d") == 0) & F.coalesce(F.col("other_time") <= now, F.lit(False))))
    return pairs.groupBy("id").agg(F.min_by("other", F.struct("other_car", "other_d", "other")).alias("nearer"))


def tour_route(df: DataFrame, most: int = 120) -> DataFrame:
    """For each tour key its stops in order of date: (key, stops, venues, route)."""
    rows = tours(df, most).join(df.select("id", "date", "venue", "ord"), "id")
    stop = F.array_sort(F.collect_list(F.struct("date", "ord", "venue")))
    out = rows.groupBy("key").agg(F.count("*").alias("stops"), F.countDistinct("venue").alias("venues"), stop.alias("s"))
    return out.select("key", "stops", "venues", F.array_join(F.transform("s", lambda x: x["venue"]), " > ").alias("route"))


def month_counts(df: DataFrame, today: str, months: int = 18) -> DataFrame:
    """Events that overlap each of the coming months."""
    start = F.trunc(F.lit(today).cast("date"), "month")
    begin = F.greatest(F.col("date"), F.lit(today).cast("date"))
    last = F.least(F.coalesce("end", "date"), F.last_day(F.add_months(start, months - 1)))
    month = F.explode(F.sequence(F.trunc(begin, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))
    return df.where(begin <= last).select(month.alias("m")).groupBy(F.date_format("m", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def calendar_heat(df: DataFrame, month: str, today: str) -> DataFrame:
    """Per day of a month how many events overlap it, and a level 0 to 4 relative to the busiest day."""
    first = F.to_date(F.lit(f"{month}-01"))
    lo = F.greatest(F.col("date"), first, F.lit(today).cast("date"))
    hi = F.least(F.coalesce("end", "date"), F.last_day(first))
    days = df.where(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    top = days.agg(F.max("n").alias("top"))  # one row
    return days.crossJoin(F.broadcast(top)).select("day", "n", F.ceil(F.col("n") * 4 / F.col("top")).cast("int").alias("level"))


def venue_groups(df: DataFrame) -> DataFrame:
    """Venues with one name and city as one: count, next event, how many venue ids."""
    out = df.withColumn("g", venue_group("venue", "city")).groupBy("g")
    return out.agg(F.count("*").alias("n"), F.min_by("id", F.struct("d", "ord")).alias("next_id"), F.countDistinct("v").alias("ids"))


def radar(df: DataFrame, home: tuple[float, float]) -> DataFrame:
    """Per venue: count, commonest type, minutes by car, bearing, and a size class."""
    per = df.groupBy("v", "type").agg(F.count("*").alias("k"), F.first("car").alias("car"), F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    out = per.groupBy("v").agg(F.sum("k").alias("n"), F.max_by("type", F.struct("k", "type")).alias("main_type"), F.first("car").alias("car"), F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    size = F.when(F.col("n") >= 10, 3).when(F.col("n") >= 4, 2).otherwise(1)
    return out.select("v", "n", "main_type", "car", F.round(bearing(home[0], home[1], F.col("lat"), F.col("lon")), 3).alias("bearing"), size.alias("size"))


def night_at(df: DataFrame, day: int, minute: int) -> DataFrame:
    """Events that run at a minute of an evening; after midnight still belongs to the evening before (minute over 1440)."""
    early = F.col("time") < 4 * 60
    evening = F.when(early, F.col("d") - 1).otherwise(F.col("d"))
    begin = F.when(early, F.col("time") + 1440).otherwise(F.col("time"))
    return df.where(F.col("time").isNotNull() & (evening == day) & (begin <= minute) & (F.lit(minute) < begin + 120))


def night_cities(df: DataFrame, day: int, minute: int) -> DataFrame:
    rows = night_at(df, day, minute)
    return rows.groupBy("city").agg(F.count("*").alias("events"), F.countDistinct("v").alias("venues"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def film_days(df: DataFrame) -> DataFrame:
    """Per day and film: showings, cinemas, lowest price, and the times at the nearest cinema."""
    films = df.where("type = 'film'").withColumn("near", F.dense_rank().over(Window.partitionBy("d", "ak").orderBy(F.coalesce("car", F.lit(999)), "v")))
    times = F.array_join(F.array_sort(F.collect_set(F.when(F.col("near") == 1, F.col("time")))), ",")
    return films.groupBy("d", "ak").agg(F.count("*").alias("showings"), F.countDistinct("v").alias("cinemas"), F.min("price").alias("price"), times.alias("nearest_times"))


def search_counts(df: DataFrame, query: str, current: str, top: int = 12) -> DataFrame:
    """The first ``top`` hits of each type with the type's total, the current type first."""
    hits = df.where(matches(query))
    totals = hits.groupBy("type").agg(F.count("*").alias("total"))  # a row a type
    place = F.row_number().over(Window.partitionBy("type").orderBy("d", F.coalesce("time", F.lit(NO_TIME)), "ord"))
    ranked = hits.withColumn("rank", place).where(F.col("rank") <= top)  # limited in each partition before the shuffle
    return ranked.join(F.broadcast(totals), "type").withColumn("tab_order", F.when(F.col("type") == current, 0).otherwise(1))


def added_per_day(df: DataFrame, days: int = 7) -> DataFrame:
    return df.where(F.col("age") <= days).groupBy("age").agg(F.count("*").alias("n"))


def list_counters(df: DataFrame, now: int) -> DataFrame:
    """One row: events, films, showings, finished today, free, followable acts."""
    finished = (F.col("d") == 0) & ~F.col("started") & F.col("time").isNotNull() & (F.col("time") + 120 <= now)
    return df.agg(F.count("*").alias("events"), F.count_if(F.col("type") == "film").alias("showings"), F.countDistinct(F.when(F.col("type") == "film", F.col("ak"))).alias("films"), F.count_if(finished).alias("finished"), F.count_if(F.col("price") == 0).alias("free"))


def agenda_days(df: DataFrame, n: int = 70, selected: int | None = None) -> DataFrame:
    days = df.select("d").distinct()
    first = days.orderBy("d").limit(n)
    return first if selected is None else first.union(days.where(F.col("d") == selected)).distinct()


def elsewhere(df: DataFrame, day: int) -> DataFrame:
    """For an empty day: how many events other days have and the first month with any."""
    return df.where(~on_day(day)).agg(F.count("*").alias("n"), F.date_format(F.min("date"), "yyyy-MM").alias("first_month"))


def facets(df: DataFrame) -> DataFrame:
    """(facet, value, n) of regions, genres, cities and venues in one pass."""
    value = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in (("region", "prov"), ("genre", "genre"), ("city", "city"), ("venue", "venue")))))
    return df.select(value.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def plan_overlaps(plans: DataFrame, slice_minutes: int = 1440) -> DataFrame:
    """plans(owner, id, s, e in absolute minutes) -> (owner, id, overlaps): the first other plan, by start and id, that intersects.

    A sweep over sorted starts, not pairs. Of the plans before one, the first that ends after it starts is a record: one
    that ends later than all before it. Records are in the order of their ends, so the one wanted is the next record end
    after the plan's start; without an earlier one only the plan that follows in order can be the first. Owners are cut in
    time slices: a slice gets the records that end in it, and the first that ends beyond it, and work is that of sorting
    within slices. Plans that end when they start, or before, overlap nothing.
    """
    p = plans.where("e > s").select("owner", "id", "s", "e", F.floor(F.col("s") / slice_minutes).alias("t"))
    by_slice = Window.partitionBy("owner").orderBy("t")  # a row a slice
    in_slice = Window.partitionBy("owner", "t").orderBy("s", "id")
    slices = p.groupBy("owner", "t").agg(F.max("e").alias("most"), F.min(F.struct("s", "id")).alias("head"))
    slices = slices.select("owner", "t", F.max("most").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("head").over(by_slice).alias("after"))
    known = p.join(slices, ["owner", "t"])
    known = known.withColumns({"earlier": F.greatest("before", F.max("e").over(in_slice.rowsBetween(Window.unboundedPreceding, -1))), "next": F.coalesce(F.lead(F.struct("s", "id")).over(in_slice), "after")})
    records = known.where("earlier is null or e > earlier").select("owner", F.floor((F.col("e") - 1) / slice_minutes).alias("t"), "e", "id")
    # for every slice the first record that ends beyond it
    ends = records.groupBy("owner", "t").agg(F.min(F.struct("e", "id")).alias("first"))
    marks = ends.unionByName(p.select("owner", "t").distinct().withColumn("first", F.lit(None).cast(ends.schema["first"].dataType))).groupBy("owner", "t").agg(F.max("first").alias("first"))
    later = Window.partitionBy("owner").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = marks.select("owner", "t", F.last("first", ignorenulls=True).over(later)["id"].alias("beyond"))
    # ends and starts of a slice from the last to the first: the record seen last is the next after a start
    both = known.select("owner", "t", F.col("s").alias("at"), F.lit(1).alias("kind"), "id", "e", "next").unionByName(records.select("owner", "t", F.col("e").alias("at"), F.lit(0).alias("kind"), "id"), allowMissingColumns=True)
    down = Window.partitionBy("owner", "t").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("record", F.last(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(down)).where("kind = 1").join(beyond, ["owner", "t"])
    first = F.coalesce("record", "beyond")
    found = F.when(first != F.col("id"), first).when(F.col("next.s") < F.col("e"), F.col("next.id"))
    return seen.select("owner", "id", found.alias("overlaps")).where("overlaps is not null")


def relink_plans(plans: DataFrame, events: DataFrame, minutes: int = 30) -> DataFrame:
    """plans(plan, date, venue, ak, time) -> (plan, id): the event that an id change hid.

    The same date, venue and act; the exact time if there is one, else the only candidate within ``minutes``.
    """
    e = events.select("id", "date", "venue", "ak", F.col("time").alias("etime"))
    c = plans.join(e, ["date", "venue", "ak"]).withColumn("exact", F.col("time").eqNullSafe(F.col("etime")))
    c = c.where("exact or abs(time - etime) <= " + str(int(minutes)))
    w = Window.partitionBy("plan")
    c = c.withColumns({"exacts": F.count_if("exact").over(w), "all": F.count("*").over(w)})
    return c.where("(exact and exacts >= 1) or (exacts = 0 and all = 1)").groupBy("plan").agg(F.min("id").alias("id"))


def lanes(slots: DataFrame) -> DataFrame:
    """slots(v, day, id, s, e) -> lane: the first lane that is free at the slot's start (first fit by start).

    An ordered fold over one venue's day, a small group by nature.
    """
    item = F.struct("s", "e", "id")
    ordered = F.array_sort(F.collect_list(item))
    empty = F.struct(F.array().cast("array<bigint>").alias("ends"), F.array().cast("array<struct<id:string,lane:int>>").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        free = F.array_position(F.transform(acc["ends"], lambda e: e <= x["s"]), True).cast("int")
        lane = F.when(free > 0, free).otherwise(F.size(acc["ends"]) + 1)
        ends = F.when(free > 0, F.transform(acc["ends"], lambda e, i: F.when(i == free - 1, x["e"]).otherwise(e))).otherwise(F.concat(acc["ends"], F.array(x["e"])))
        return F.struct(ends.alias("ends"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), lane.cast("int").alias("lane")))).alias("out"))

    typed = slots.select("v", "day", F.col("id").cast("string").alias("id"), F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))
    done = typed.groupBy("v", "day").agg(F.aggregate(ordered, empty, put, lambda a: a["out"]).alias("x"))
    return done.select("v", "day", F.explode("x").alias("x")).select("v", "day", "x.id", "x.lane")


def act_blocks(times: Column, doors: Column, key: Column) -> Column:
    """Blocks of known act times (s in minutes, a): an act ends five minutes before the next one, after 15 minutes at least;
    the main act, by its key or else the last, after 120 at most and the others after 75."""
    own = F.array_position(F.transform(times, lambda x: artist_key(x["a"]) == key), True).cast("int")
    n = F.size(times)

    def block(x: Column, i: Column, main: Column) -> Column:
        following = F.get(times, i + 1)["s"]
        end = F.when(following.isNotNull(), F.greatest(x["s"] + 15, following - 5)).otherwise(x["s"] + F.when(i == main, 90).otherwise(45))
        end = F.when((i == main) & following.isNull(), x["s"] + 90).otherwise(F.least(end, x["s"] + F.when(i == main, 120).otherwise(75)))
        return F.struct(F.when(i == main, "main").otherwise("sup").alias("k"), x["s"].cast("int").alias("s"), end.cast("int").alias("e"), F.lit(False).alias("est"))

    first = F.get(times, F.lit(0))["s"]
    door = F.array(F.struct(F.lit("door").alias("k"), doors.cast("int").alias("s"), F.least(doors + 30, first).cast("int").alias("e"), F.lit(False).alias("est")))
    # keys are made once a row, not for each act and each time that the main one is named
    blocks = let(own, lambda o: F.transform(times, lambda x, i: block(x, i, F.when(o > 0, o).otherwise(n) - 1)))
    return F.concat(F.when(doors < first, door).otherwise(F.slice(door, 1, 0)), blocks)


def first_films(df: DataFrame) -> DataFrame:
    """A showing that a house's own agenda and the film agenda both have stands once: the first by venue name, date, time
    and bare title; a missing time is a time. All other events stay."""
    name = lambda c: F.lower(F.coalesce(c, F.lit("")))
    key = [name(F.col("venue")).alias("_v"), F.col("date"), F.col("time"), F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("_t")]
    films = df.where(F.col("type") == "film")
    first = films.groupBy(*key).agg(F.min("ord").alias("ord")).select("ord")
    return films.join(first, "ord", "left_semi").select(df.columns).unionByName(df.where(~F.coalesce(F.col("type") == "film", F.lit(False))))


def unfinished(df: DataFrame, ends: DataFrame, now: int) -> DataFrame:
    """Events without those of today that are over: ends(id, end_minute), else two hours after their time, lie behind ``now``.

    Periods, events of earlier days and those without a time aren't over.
    """
    timed = df.join(ends.groupBy("id").agg(F.max("end_minute").alias("_end")), "id", "left")
    over = (F.col("d") == 0) & ~F.col("started") & F.col("end_d").isNull() & F.col("time").isNotNull() & (F.coalesce("_end", F.col("time") + 120) <= now)
    return timed.where(~F.coalesce(over, F.lit(False))).select(df.columns)


def grid_hours(slots: DataFrame, events: DataFrame) -> DataFrame:
    """(d, first, last, unknown): the whole hours that a day's schedule spans, three at least, and its events without a time."""
    start = F.col("time") - F.when(F.col("type") == "thea", 30).otherwise(0)
    ends = slots.groupBy("id").agg(F.max_by("e", "s").alias("_e"))
    day = events.join(ends, "id", "left").groupBy("d").agg(F.min(start).alias("a"), F.max(F.when(F.col("time").isNotNull(), F.col("_e"))).alias("b"), F.count_if(F.col("time").isNull()).alias("unknown"))
    first = (F.floor(F.col("a") / 60) * 60).cast("int")
    return day.select("d", first.alias("first"), F.greatest(first + 180, (F.ceil(F.col("b") / 60) * 60).cast("int")).alias("last"), "unknown")


def venue_list(df: DataFrame, kinds: Sequence[str] = (), query: str = "") -> DataFrame:
    """(key, name, city, type, n, next_d, car): venues of the same name and city with their number of events and next day."""
    key = F.lower(F.concat_ws("|", "venue", "city"))
    rows = df.withColumns({"key": key, "_hay": search_fold(F.concat_ws(" ", "venue", "city"))})
    if kinds:
        rows = rows.where(F.col("vtype").isin(*kinds))
    if query.strip():
        words = F.filter(F.split(search_fold(F.lit(query)), r"\s+"), lambda w: w != "")
        rows = rows.where(F.forall(words, lambda w: F.col("_hay").contains(w)))
    return rows.groupBy("key").agg(F.min_by("venue", "ord").alias("name"), F.min_by("city", "ord").alias("city"), F.min_by("vtype", "ord").alias("type"), F.count("*").alias("n"), F.min("d").alias("next_d"), F.min_by("car", "ord").alias("car"))


def venue_agenda(df: DataFrame, key: str) -> DataFrame:
    """A venue's events with their ``place`` on its page: what runs already, then by day and time, unknown times last."""
    own = df.where(F.lower(F.concat_ws("|", "venue", "city")) == key)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("venue").orderBy(F.col("started").desc(), "d", F.coalesce("time", F.lit(1440)), "ord")))


def time_slots(df: DataFrame) -> DataFrame:
    """One row per block of an event's evening: (id, k, s, e, est), k is door, sup or main.

    Known act times first; else by kind: films by length, theatre with doors, parties and festivals long, concerts
    with or without support. A known end closes the last block if it is at most 14 hours later.
    """
    doors, start, tot, dur = (has(df, c, "int") for c in ("doors", "start", "tot", "dur"))
    support = has(df, "support", "array<string>")
    n = F.size(F.coalesce(support, F.array().cast("array<string>")))
    t = F.coalesce(start, F.col("time"))
    block = lambda k, s, e, est: F.struct(F.lit(k).alias("k"), s.cast("int").alias("s"), e.cast("int").alias("e"), est.alias("est"))
    yes, no = F.lit(True), F.lit(False)
    door = F.coalesce(doors, F.col("time"))
    known = F.when(start > door, start).when(F.col("time") > door, F.col("time"))
    main = F.coalesce(known, door + 60)
    with_support = F.when(start > door, start).otherwise(door + 30 + 55 * n)
    first_support = F.greatest(with_support - 55 * n, door + 15)
    supports = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: block("sup", first_support + 55 * i, first_support + 55 * i + 40, yes))
    acts = has(df, "times", "array<struct<s:int,a:string>>")
    blocks = (
        F.when(F.size(acts) > 0, act_blocks(acts, doors, F.col("ak") if "ak" in df.columns else F.lit("")))
        .when(F.col("time").isNull() & start.isNull(), F.array().cast("array<struct<k:string,s:int,e:int,est:boolean>>"))
        .when(F.col("type") == "film", F.array(block("main", t, t + F.coalesce(dur, F.lit(120)), dur.isNull())))
        .when(F.col("type") == "thea", F.array(block("door", F.coalesce(doors, t - 30), t, doors.isNull()), block("main", t, t + 120, no)))
        .when((F.col("genre") == "Feest") | ((F.col("genre") == "Dance") & (t >= 1320)), F.array(block("main", t, t + 240, no)))
        .when(F.col("type") == "fest", F.array(block("main", t, t + 360, no)))
        .when((n == 0) & doors.isNull() & ~F.coalesce(start > F.col("time"), no), F.array(block("main", F.col("time"), F.col("time") + 120, no)))
        .when(n == 0, F.array(block("door", door, F.least(door + 30, main), no), block("main", main, main + 90, known.isNull())))
        .otherwise(F.concat(F.array(block("door", door, door + 30, no)), supports, F.array(block("main", with_support, with_support + 90, start.isNull()))))
    )
    rows = df.select("id", tot.alias("tot"), F.explode(F.array(blocks)).alias("blocks"))  # computed once
    rows = rows.select("id", "tot", F.posexplode("blocks").alias("i", "b"), F.size("blocks").alias("m"))
    stop = F.when(F.col("tot") <= F.col("b.s"), F.col("tot") + 1440).otherwise(F.col("tot"))
    closes = (F.col("i") == F.col("m") - 1) & F.coalesce(stop - F.col("b.s") <= 840, no)
    return rows.select("id", F.col("b.k").alias("k"), F.col("b.s").alias("s"), F.when(closes, stop).otherwise(F.col("b.e")).alias("e"), (F.col("b.est") & ~closes).alias("est"))


def same_genre_picks(df: DataFrame, artists: DataFrame, n: int = 6) -> DataFrame:
    """The nearest events of unfollowed acts in the genres of followed ones, one for each act."""
    generic = ("Overig", "Feest", "Theater", "Festival", "Film")
    liked = followed(df, artists).where(~F.col("genre").isin(*generic)).select("genre").distinct()
    new = df.join(liked, "genre", "left_semi").join(artists, "ak", "left_anti")
    one = new.withColumn("r", F.row_number().over(Window.partitionBy("ak").orderBy(F.coalesce("car", F.lit(999)), "d", "ord"))).where("r = 1")
    return one.orderBy(F.coalesce("car", F.lit(999)), "d", "ord").limit(n)


def random_picks(df: DataFrame, seed: int, seen: DataFrame | None = None) -> DataFrame:
    """One event of each type, drawn evenly over (act, venue) and then over its showings, by digests with a seed."""
    rows = df if seen is None else df.join(seen, "id", "left_anti")
    rank = lambda *c: F.md5(F.concat_ws("|", F.lit(str(seed)), *c))
    group = rows.groupBy("type", "ak", "v").agg(F.min_by("id", rank("id")).alias("id"))
    return group.groupBy("type").agg(F.min_by("id", rank("ak", "v")).alias("id"))


def surprise(df: DataFrame, seed: int, now: int, weekend: tuple[int, int], seen: DataFrame, last: str | None = None, kinds: tuple[str, ...] = ("pop", "thea", "film"), max_car: int = 45) -> DataFrame:
    """(id, rung): one event drawn from the first rung of the ladder that has any: today, this weekend, the next 14 days.

    Only events with a time that isn't over, not sold out nor cancelled, of the ``kinds`` and within reach; the last rung
    leaves periods out. What was shown before, seen(key) of ``type|ak|v``, goes; where nothing else is left, all but the
    ``last`` one shown may come again, and that one if it is alone. Then a type is drawn, a title and venue, and a
    showing, evenly each: by the smallest digest of the seed and the name. The rung is chosen in the plan, as the
    smallest that any row has; nothing is asked of the driver. No row if every rung is empty.
    """
    key = F.concat_ws("|", "type", "ak", "v")
    usable = F.col("time").isNotNull() & ~F.coalesce(F.col("status"), F.lit("")).isin("sold", "cancelled") & ~((F.col("d") == 0) & (F.col("time") <= now)) & ~F.col("started")
    rung = F.when(F.col("d") == 0, 1).when(F.col("d").between(*weekend), 2).when(F.col("d").between(0, 14) & F.col("end_d").isNull(), 3)
    rows = df.where(usable & F.col("type").isin(*kinds) & (F.col("car") <= max_car)).select("id", "type", key.alias("key"), rung.alias("rung")).where("rung is not null")

    def smallest(rows: DataFrame, column: str) -> DataFrame:
        least = rows.agg(F.min(column).alias("least"))  # one row
        return rows.crossJoin(F.broadcast(least)).where(F.col(column) == F.col("least")).drop("least")

    pool = smallest(rows, "rung").join(seen.select("key", F.lit(True).alias("shown")).distinct(), "key", "left")
    again = F.when(F.col("shown").isNull(), 0).when(~F.col("key").eqNullSafe(F.lit(last)), 1).otherwise(2)
    fresh = smallest(pool.withColumn("again", again), "again")
    draw = lambda c: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), F.col(c))), F.col(c))
    return fresh.orderBy(draw("type"), draw("key"), draw("id")).limit(1).select("id", "rung")
