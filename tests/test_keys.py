"""Key functions on hand cases."""

from datetime import date

from pyspark.sql import functions as F

from evenloom.functions import extract as X
from evenloom.functions import keys as K
from evenloom.functions.geo import haversine_km, travel
from evenloom.operators import classify as C


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_keys(spark):
    v = lambda f, t: value(spark, f(F.lit(t)))
    assert v(K.slug, "Café De Zwaan / Tilburg!") == "caf-de-zwaan-tilburg"
    assert v(K.norm14, "Rock &amp; Roll Night Special") == "rockrollnights"
    assert v(K.artist_key, "Björk & Sigur Rós") == "bjorksigurros"
    assert v(K.headline, "Act - the tour (festival, dag 2)") == "Act"
    assert v(K.first_act, "CARSICK + CARNE") == v(K.first_act, "Carsick (op locatie)") == "carsick"
    assert v(K.film_key, "Filmkring: Sense and Sensibility (2025)") == "senseandsensibility"
    assert sorted(v(K.title_tokens, "Herrie op de Heuvel, herrie")) == ["de", "herrie", "heuvel", "op"]
    assert v(K.compare_key, "The Beatles & Friends") == "beatlesfriends" and v(K.compare_key, "The The") == "thethe"
    assert v(K.search_fold, "Ørsted “Œuvre” ł") == 'orsted "oeuvre" l'
    assert v(K.city_key, "Den Bosch") == v(K.city_key, "'s-Hertogenbosch") == "s hertogenbosch"
    assert v(K.url_host, "https://www.X.nl/a?b") == "x.nl" and v(K.url_page, "https://x.nl/a/?b=1") == "https://x.nl/a"
    assert v(K.acts, "Popronde: A + B") == ["A", "B"] and v(K.acts, "Instore: C") == ["C"]
    assert v(K.tour_keys, "Thijs van de Meeberg - Baby Reindeer") == ["thijsvandemeeberg", "babyreindeer"] and v(K.tour_keys, "Act - Tour 2026") == ["act"]


def test_amounts(spark):
    cases = {"€ 24,50": 24.5, "24,-": 24.0, "1.250,00": 1250.0, "12.5": 12.5, "gratis": None, "1,2,3": None, "19": 19.0}
    for t, want in cases.items():
        assert value(spark, X.amount(F.lit(t))) == want, t


def test_prices_in_text(spark):
    cases = {
        "Tickets vanaf €19,- excl. servicekosten": 19.0, "Entree: gratis": 0.0, "Entree € 15, kinderen gratis": 15.0, "€ 24,50 in de zaal": 24.5, "Parkeerkosten € 5,00": None, "Gratis toegang voor leden": None,
        "Voorverkoop € 12,50 kassa € 15,00": 12.5, "niets": None,
    }
    for t, want in cases.items():
        assert value(spark, X.price_from_text(F.lit(t))) == want, t


def test_dates(spark):
    rows = [("do 22 okt 2026 om 20:00", date(2026, 10, 22)), ("22-10-2026", date(2026, 10, 22)), ("October 5, 2026", date(2026, 10, 5)), ("3 januari", date(2027, 1, 3)), ("1 mei 2030, Datum: 2 juni 2027", date(2027, 6, 2)), ("31 februari 2026", None), ("you may 20:30", None), ("Datum: 4-12", date(2026, 12, 4)), ("", None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    got = {r.k: r.date for r in X.with_date(df, "t", F.lit("2026-10-01").cast("date")).collect()}
    assert [got[k] for k in range(len(rows))] == [d for _, d in rows]


def test_film_and_genre(spark):
    film = lambda t, u="https://x.nl/a", vt="pop": value(spark, C.is_film(F.lit(t), F.lit(u), F.lit(vt)))
    assert film("Filmavond") and film("Naked (1993)") and film("X", vt="film") and film("X", "https://x.nl/film/x") and not film("Star Wars in concert") and not film("Expo over film", vt="museum")
    genre = lambda t: value(spark, C.keyword_genre(F.lit(t)))
    assert genre("Musical met tribute") == "Musical" and genre("Beat DJ set") == "Dance" and genre("Kinderconcert") == "Jeugd" and genre("Iets") is None
    assert value(spark, C.is_kids(F.lit("Nijntje (4+)"), F.lit("Pop"))) and not value(spark, C.is_kids(F.lit("Band 16+"), F.lit("Pop")))


def test_travel(spark):
    t = value(spark, travel(haversine_km(51.5555, 5.0913, F.lit(51.5719), F.lit(4.7683))))
    assert (t.car, t.mode, t.walk) == (28, "car", None)
    near = value(spark, travel(F.lit(0.5)))
    assert (near.car, near.walk, near.mode) == (7, 8, "walk") and value(spark, travel(F.lit(None).cast("double"))) is None
