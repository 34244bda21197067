"""Classification of events: film or not, genre, type of venue, kids, eligibility for artist matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import artist_key, film_key, headline

#: What makes a title or address a film, and live music to film.
FILM = r"(?i)\b(films?|filmhuis\w*|filmclub|filmkring|film ?avond|filmmiddag|filmochtend|filmmatinee|film ?vertoning|filmvoorstelling|filmprogramma|filmreeks|film ?festival|film ?tour|\w+film|documentaires?|documentary|docu|albumovie|screening|vertoning|voorpremi[eè]re|movies that matter|kom movies|viewing party|bioscoop)\b"
FILM_URL = r"(?i)/(films?|cinema|bioscoop|filmhuis|filmtheater)(/|$)"
FILM_YEAR = r"\((19[3-9]\d|20\d\d)\)"
LIVE_MUSIC = r"(?i)in concert|live[- ]to[- ]film|film ?concert|film ?muziek|film ?music|filmorkest|film orchestra|live[- ](soundtrack|score|muziek|begeleid\w*|gespeeld|orkest|op (het )?orgel)|met live|orkest|orchestra|symfon|symphon|sing[- ]?along|meezing|cinemusic|stomme film|stille film|silent film|\((18\d\d|19[0-2]\d)\)|eigen film"
#: Words of a title and the genre they mean; the first list that matches counts.
GENRE_WORDS = (
    ("Musical", ("musical",)), ("Opera", ("opera",)), ("Dans", ("dans", "ballet", "dance company")),
    ("Cabaret", ("cabaret", "comedy", "stand-up", "standup", "try-out", "oudejaars")),
    ("Klassiek", ("symfon", "orkest", "philharmon", "strijkkwartet", "kamermuziek", "concertgebouw", "requiem", "passion", "matthäus", "bach", "mozart", "beethoven", "recital", "koor")),
    ("Jazz", ("jazz", "big band", "bigband")),
    ("Jeugd", ("kindervoorstelling", "kinderconcert", "kinderfilm", "familievoorstelling", "familieconcert", "familiefilm", "familietheater", "(2+)", "(3+)", "(4+)", "(5+)", "(6+)", "(7+)", "(8+)", "(9+)", "(10+)", "jeugdtheater", "peuter", "kleuter")),
    ("Tribute", ("tribute", "undercover", "coverband", "plays the music of", "a tribute", "celebrating")),
    ("Feest", ("party", "feest", "fuif", "silent disco", "jukebox", "bingo", "afterparty", "karaoke")),
    ("Dance", ("techno", "house", " dj", "rave", "hardstyle", "drum & bass", "dnb")),
    ("Metal", ("metal", "doom", "sludge", "grindcore")), ("Punk", ("punk", "hardcore")),
    ("Nederlandstalig", ("hollandse", "toppers", "nederlandstalig", "smartlap")),
    ("Lezing", ("lezing", "talk", "podcast", "debat", "college")), ("Toneel", ("toneel", "voorstelling", "theater")),
)
#: Genres as published.
DEFAULT_GENRE = {"pop": "Overig", "concert": "Klassiek", "arena": "Overig", "cafe": "Overig", "thea": "Theater", "museum": "Tentoonstelling", "festival": "Festival", "film": "Film"}
#: Genres as published.
ALLOWED_GENRES = ("Pop", "Rock", "Indie", "Metal", "Punk", "Hiphop", "Dance", "Jazz", "Soul/Funk", "Blues", "Folk/Americana", "Wereld", "Nederlandstalig", "Singer-songwriter", "Klassiek", "Tribute", "Feest", "Cabaret", "Lezing", "Jeugd", "Toneel", "Musical", "Dans", "Opera", "Muziektheater", "Show", "Circus")


def is_film(title: Column, url: Column, vtype: Column, screening: Column | None = None) -> Column:
    screening = F.coalesce(screening, F.lit(False)) if screening is not None else F.lit(False)
    page = F.split(F.coalesce(url, F.lit("")), r"\?")[0]
    words = F.regexp_replace(F.element_at(F.split(F.regexp_replace(page, "/+$", ""), "/"), -1), "[-_]+", " ")
    bare = F.regexp_replace(title, r"\s\|\s[^|—]*$", "")
    shown = screening | title.rlike(r"(?i)film ?vertoning|screening|film ?avond|filmmiddag")
    film = screening | bare.rlike(FILM) | words.rlike(FILM) | page.rlike(FILM_URL) | bare.rlike(FILM_YEAR)
    return F.when(vtype == "film", True).when(vtype == "museum", shown).otherwise(~(bare.rlike(LIVE_MUSIC) | words.rlike(LIVE_MUSIC)) & film)


def keyword_genre(title: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(title))
    out = F.lit(None).cast("string")
    for genre, words in reversed(GENRE_WORDS):
        found = low.contains(words[0])
        for w in words[1:]:
            found = found | low.contains(w)
        out = F.when(found, genre).otherwise(out)
    return out


def default_genre(vtype: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in DEFAULT_GENRE.items() for x in kv))
    return F.coalesce(F.try_element_at(table, vtype), F.lit("Overig"))


def known_genre(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``known_genre`` from dictionary(key, genre): by the full title, then by the headline; only allowed genres.

    The dictionary is an input of any size; Spark broadcasts it if it is small.
    """
    allowed = dictionary.where(F.col("genre").isin(*ALLOWED_GENRES)).groupBy("key").agg(F.min("genre").alias("g"))
    out = events.withColumns({"_full": artist_key("title"), "_head": artist_key(headline("title"))})
    out = out.join(allowed.select(F.col("key").alias("_full"), F.col("g").alias("_a")), "_full", "left")
    out = out.join(allowed.select(F.col("key").alias("_head"), F.col("g").alias("_b")), "_head", "left")
    return out.withColumn("known_genre", F.coalesce("_a", "_b")).drop("_full", "_head", "_a", "_b")


def guess_genre(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``guessed``: youth if the first matching keyword list is youth, else dictionary, keyword, default by venue type."""
    word = keyword_genre(F.col("title"))
    guess = F.when(word == "Jeugd", "Jeugd").otherwise(F.coalesce(F.col("known_genre"), word, default_genre(F.col("vtype"))))
    return known_genre(events, dictionary).withColumn("guessed", guess)


def assign_genre(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Film test, then the source's fixed genre (``source_genre``, may be absent), then the guess."""
    fixed = F.col("source_genre") if "source_genre" in events.columns else F.lit(None).cast("string")
    screening = F.col("screening") if "screening" in events.columns else None
    film = is_film(F.col("title"), F.col("url"), F.col("vtype"), screening)
    return guess_genre(events, dictionary).withColumn("genre", F.when(film, "Film").otherwise(F.coalesce(fixed, F.col("guessed")))).drop("guessed", "known_genre")


def mark_known_films(events: DataFrame) -> DataFrame:
    """Events become films if a film elsewhere has their title and their venue shows films; never at museums and festivals."""
    rows = events.withColumn("_key", film_key("title"))
    films = rows.where((F.col("genre") == "Film") & (F.length("_key") >= 4)).select("_key").distinct().withColumn("_film", F.lit(True))
    houses = rows.where("genre = 'Film'").select("venue").distinct().withColumn("_house", F.lit(True))
    out = rows.join(films, "_key", "left").join(houses, "venue", "left")
    becomes = (F.col("genre") != "Film") & F.col("_film") & F.col("_house") & ~F.col("vtype").isin("museum", "festival") & ~F.col("title").rlike(LIVE_MUSIC)
    return out.withColumn("genre", F.when(F.coalesce(becomes, F.lit(False)), "Film").otherwise(F.col("genre"))).drop("_key", "_film", "_house")


def venue_type(name: Column, keywords: list[str], overrides: dict[str, str]) -> Column:
    low = F.lower(name)
    thea = F.exists(F.array(*(F.lit(k) for k in keywords)), lambda k: low.contains(k)) if keywords else F.lit(False)
    out = F.when(thea, "thea").otherwise("pop")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)), name), out) if overrides else out


#: Words of titles for children.
KIDS = (
    r"(?i)kinder(?!loos|achtig)|\bkids?\s*(edition|editie|club|factory|rondleiding|atelier|workshop|middag|dag|disco|concert|voorstelling|theater|tour|special|feest|party)\b|\bkids\s*/\s*jeugd|\bkids\s+x\s|voor (de )?kids|met kids|\bkids\s*$|nederlandse versie|nl versie|2d nl|nl gesproken|nederlands gesproken|\b(museum|edition|editie|bookshop)\s+kids\b|"
    r"familie(voorstelling|concert|film|dag|theater|middag|musical|tour|tentoonstelling|programma|zondag|weekend|activiteit|vertelling)|familietheater|voor (het hele )?gezin|gezinsvoorstelling|\bjeugd(theater|voorstelling|film|concert|orkest)|peuter|kleuter|\bjunior|voorlees|poppenkast|poppentheater|sprookje|sinterklaas|\bsint\b|"
    r"nijntje|dikkie dik|kikker|buurman en buurman|pieter post|paw patrol|\bk3\b|samson|bumba|woezel|\bpip\b|pippi|minoes|pluk van de petteflet|jip en janneke|taartrovers|cinemini|kidsclub|kinderfeest|schoolvoorstelling"
)


def min_age(title: Column) -> Column:
    found = F.regexp_extract(title, r"^(\d{1,2})\s*\+|\b(\d{1,2})(?:,\d)?\s*\+(?=\s*(?:\)|$|[-–—,|/(]|jaar\b|jr\b))|(?i:\bvanaf\s+(\d{1,2})\s+jaar)", 0)
    return F.regexp_extract(found, r"(\d{1,2})", 1).try_cast("int")


def is_kids(title: Column, genre: Column) -> Column:
    dubbed = genre.isin("Film", "Theater", "Jeugd", "Musical", "Toneel") & title.rlike(r"(?i)\(nl\)")
    return F.when(min_age(title).isNotNull(), min_age(title) <= 12).when(title.rlike(r"(?i)\b(16|18)\s*\+|\bvolwassen"), False).otherwise(title.rlike(KIDS) | dubbed)


def genre_worklist(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Keys without a real genre that the dictionary lacks: how often, with the first title, most frequent first."""
    key = F.when(F.col("vtype") == "thea", artist_key("title")).otherwise(artist_key(headline("title")))
    open_ = events.where(F.col("genre").isin("Overig", "Theater")).withColumn("key", key).where("length(key) >= 2")
    out = open_.groupBy("key").agg(F.count("*").alias("n"), F.min_by("title", "ord").alias("example"))
    return out.join(dictionary.select("key"), "key", "left_anti").orderBy(F.desc("n"), "key")


def listing_genres(events: DataFrame, listings: DataFrame, by_kind: dict[str, str]) -> DataFrame:
    """Genre from the first genre listing (id, genre, place) that has an event, else by its kind."""
    first = listings.groupBy("id").agg(F.min_by("genre", "place").alias("listed"))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in by_kind.items() for x in kv)), F.col("kind"))
    return events.join(first, "id", "left").withColumn("genre", F.coalesce("listed", kind, F.lit("Overig"))).drop("listed")


def changed_genres(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of (old, new) genres that a reclassification changed."""
    both = before.select("id", F.col("genre").alias("old")).join(after.select("id", F.col("genre").alias("new")), "id")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).groupBy("old", "new").agg(F.count("*").alias("n"))
