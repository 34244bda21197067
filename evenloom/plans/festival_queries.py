"""The query of festival dates over sites made of the orders: every grammar, guard and source of a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import festivals as S
from .binding import table

TODAY = "2026-01-10"
DUTCH = "jan feb mrt april mei juni juli aug september okt november december".split()
ENGLISH = "January February March April May June July Aug Sept October Nov Dec".split()


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    a = F.make_date(F.lit(2026), (2 + F.col("o_custkey") % 11).cast("int"), (1 + k % 20).cast("int"))
    rows = table(spark, sf_dir, "orders").select(k.alias("source"), (k % 13).alias("k"), a.alias("a"), F.date_add(a, (1 + F.col("o_custkey") % 4).cast("int")).alias("b"))
    name = lambda c, of: F.element_at(F.array(*(F.lit(m) for m in of)), F.month(c))
    d = lambda c: F.dayofmonth(c).cast("string")
    nl, en, a1, later = name("a", DUTCH), name("a", ENGLISH), F.date_add("a", 1), F.add_months("a", 1)
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    dotted = lambda c: F.date_format(c, "dd.MM.yyyy")
    texts = (
        say("Feest op ", d("a"), ", ", d(a1), " &amp; ", d(F.date_add("a", 2)), " ", nl, " 2026 in het park"), say("vr ", d("a"), " - zo ", d("b"), " ", nl), say("tussen ", d("a"), " ", nl, " 2026 en ma ", d(later), " ", name(later, DUTCH), " ", F.year(later).cast("string")), say(en, " ", d("a"), "th - ", d("b"), ", 2026"),
        say("van ", dotted("a"), " t/m ", dotted("b")), say("Tickets t/m ", d("a"), " ", nl, " bestellen! Festival: ", d(a1), " ", nl, " 2026."), say("De editie van 2025 vindt plaats van ", d("a"), " - ", d("b"), " ", nl), say('<script>{"dayOne":"', F.col("a").cast("string"), '","x":1,"dayLast":"', F.col("b").cast("string"), '"}</script>', d(a1), " ", nl),
        say(d("a"), " ", nl, " 2026 clubavond. ", d("a"), " t/m ", d("b"), " ", nl, " 2026"), say(dotted("a"), " - ", dotted(F.date_add("a", 80)), "; zie ook ", d("a"), " ", nl, " '27"), say("1 januari 2030"), say("Welkom"), say(d("a"), ".", d(a1), ".", d(F.date_add("a", 2)), " ", nl, "<!-- 1 mei 2026 --><style>2 mei 2026</style>"),
    )
    text = F.coalesce(*(F.when(F.col("k") == n, t) for n, t in enumerate(texts)))
    month = F.when(F.col("k") == 8, (F.month("a") + 3) % 12 + 1)
    pattern = F.when(F.col("k") == 7, r'"dayOne":"(\d{4}-\d\d-\d\d)".*"dayLast":"(\d{4}-\d\d-\d\d)"').when(F.col("k") == 12, r'"day[(]":"(\d{4}-\d\d-\d\d)"')
    meta = F.when(F.col("k") == 12, say('<meta property="og:title" content="3 juni"><meta name="description" content="', d("a"), " | ", d("b"), " ", nl, ' 2026">')).otherwise("")
    sites = rows.select("source", say("<html><head>", meta, "</head><body><h1>Festival</h1><p>", text, "</p></body></html>").alias("html"), month.alias("month"), pattern.alias("date_regex"))
    events = rows.where("k = 10").select("source", "a", "b").select("source", F.explode(F.array(F.struct(F.col("a").alias("date"), F.lit(None).cast("date").alias("end")), F.struct(F.date_add("a", 1).alias("date"), F.col("b").alias("end")), F.struct(F.lit("2025-01-01").cast("date").alias("date"), F.lit(None).cast("date").alias("end")))).alias("e")).select("source", "e.*")
    return sites, events


@query("x05b_festival_dates", """
    WITH o AS (SELECT o_orderkey AS source, o_orderkey % 13 AS k, make_date(2026, CAST(2 + o_custkey % 11 AS INTEGER), CAST(1 + o_orderkey % 20 AS INTEGER)) AS a, CAST(1 + o_custkey % 4 AS INTEGER) AS l FROM orders)
    SELECT source, CASE k WHEN 5 THEN a + 1 WHEN 9 THEN make_date(2027, CAST(month(a) AS INTEGER), CAST(day(a) AS INTEGER)) ELSE a END AS start,
        CASE WHEN k = 0 THEN a + 2 WHEN k = 2 THEN CAST(a + INTERVAL 1 MONTH AS DATE) WHEN k IN (5, 9) THEN NULL WHEN k = 10 THEN greatest(a + 1, a + l) ELSE a + l END AS "end" FROM o WHERE k NOT IN (6, 11)""")
def x05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, events = _sites(spark, sf_dir)
    return S.festival_periods(sites, events, TODAY)
