"""Queries of the night store, of merged caches and of nightly rules over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..sources import store as K
from ..streaming import nights as N
from .agenda_queries import W
from .binding import TODAY, agenda, table
from .document_queries import _streamed
from .storage import removed, scratch


@query("s06c_nights", f"""{W} SELECT DATE '2024-01-08' AS night, id, title FROM agenda WHERE ord % 3 <> 0 UNION ALL SELECT DATE '2024-01-09', id, concat(title, '!') FROM agenda WHERE ord % 5 = 0 UNION ALL SELECT DATE '2024-01-10', id, title FROM agenda WHERE ord % 2 = 0""")
def s06c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nights; the first is written again by a run that gives something else, the last by the same run."""
    a = agenda(spark, sf_dir).select("id", "title", "date", "ord")
    place = scratch(spark, "nights")
    for night, rows in (("2024-01-08", a.where("ord % 2 = 1")), ("2024-01-09", a.where("ord % 5 = 0").withColumn("title", F.concat("title", F.lit("!")))), ("2024-01-08", a.where("ord % 3 <> 0")), ("2024-01-10", a.where("ord % 2 = 0")), ("2024-01-10", a.where("ord % 2 = 0"))):
        K.write_night(rows.drop("ord"), night, place, "date")
    return removed(K.read_nights(spark, place, first="2024-01-01").select("night", "id", "title"), place)


@query("s12b_night_before", f"{W} SELECT DATE '2024-01-09' AS night, id FROM agenda WHERE ord % 5 = 0")
def s12b(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = agenda(spark, sf_dir).select("id", "date", "ord")
    place = scratch(spark, "nights")
    for night, rest in (("2024-01-08", 2), ("2024-01-09", 5), ("2024-01-12", 7)):
        K.write_night(a.where(F.col("ord") % rest == 0).drop("ord"), night, place, "date")
    return removed(K.latest_night(spark, place, "2024-01-11").select("night", "id"), place)


@query("t06b_cache_merge", f"""
    WITH c AS (SELECT p_partkey AS key, concat('a', p_partkey) AS value, DATE '{TODAY}' - CAST(p_partkey % 700 AS INTEGER) AS t, 'w1' AS writer FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, concat('b', p_partkey), DATE '{TODAY}' - CAST(p_partkey % 350 AS INTEGER), 'w2' FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey, NULL, NULL, 'w3' FROM part WHERE p_partkey % 4 = 0),
    m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC NULLS LAST, writer DESC) = 1)
    SELECT key, value, t, writer FROM m WHERE key % 7 = 0 OR date_diff('day', t, DATE '{TODAY}') <= 400""")
def t06b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writers' caches, and of what nothing uses only the entries that aren't old."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    entry = lambda value, days, writer: (k.alias("key"), value.cast("string").alias("value"), days.alias("t"), F.lit(writer).alias("writer"))
    ago = lambda n: F.date_sub(F.lit(TODAY).cast("date"), (k % n).cast("int"))
    one = p.where(k % 2 == 0).select(*entry(F.concat(F.lit("a"), k.cast("string")), ago(700), "w1"))
    two = p.where(k % 3 == 0).select(*entry(F.concat(F.lit("b"), k.cast("string")), ago(350), "w2"))
    three = p.where(k % 4 == 0).select(*entry(F.lit(None), F.lit(None).cast("date"), "w3"))
    return K.pruned_cache(K.merged_caches(one, two, three), p.where(k % 7 == 0).select(k.alias("key")), TODAY).select("key", "value", "t", "writer")


def _nightly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of nightly counts in several files, out of order: some sources stop for good, some for a while, some nights
    come twice, and a clock that runs on at the end."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("s"), F.to_date("ts").alias("day"))
    n = e.groupBy("s", "day").agg(F.count("*").alias("n"))
    gone = ((F.col("s") % 3 == 0) & (F.dayofmonth("day") >= 12)) | ((F.col("s") % 3 == 1) & F.dayofmonth("day").between(9, 11))
    n = n.where(~gone)
    rows = n.unionByName(n.where("s % 5 = 0").withColumn("n", F.floor(F.col("n") / 2)))
    rows = rows.select(F.col("s").cast("string").alias("source"), F.col("day").cast("timestamp").alias("night"), "n")
    clock = spark.sql("select 'clock' as source, timestamp'2024-03-20' as night, 1L as n")
    place = scratch(spark, "counts")
    rows.unionByName(clock).repartition(4, F.xxhash64("source", "night", "n")).write.parquet(place)
    return spark.readStream.schema(rows.schema).parquet(place)


_FOLD_SQL = """
    WITH RECURSIVE b AS (SELECT CAST(user_id % 60 AS VARCHAR) AS source, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE NOT ((user_id % 60 % 3 = 0 AND day(ts) >= 12) OR (user_id % 60 % 3 = 1 AND day(ts) BETWEEN 9 AND 11)) GROUP BY 1, 2),
    f AS (SELECT source, min(day) - 1 AS day, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS DATE) AS since, CAST(0 AS BIGINT) AS held FROM b GROUP BY source
        UNION ALL SELECT source, day, n, verdict, CASE WHEN verdict = 'ok' {reset} THEN day ELSE since END, CASE WHEN verdict IS NULL OR verdict = 'houd' THEN held ELSE coalesce(n, 0) END
        FROM (SELECT f.source, f.day + 1 AS day, b.n, f.since, f.held, CASE WHEN b.n IS NULL AND f.held < 6 THEN NULL WHEN NOT ({silent}) THEN 'ok' WHEN f.day + 1 - f.since {within} THEN 'houd' ELSE 'vervallen' END AS verdict
            FROM f LEFT JOIN b ON b.source = f.source AND b.day = f.day + 1 WHERE f.day < DATE '2024-03-18') x)
    SELECT source, day AS night, coalesce(n, 0) AS n, verdict, since FROM f WHERE verdict IS NOT NULL"""


def _decided(spark: SparkSession, sf_dir: str, rule: N.Rule) -> DataFrame:
    out = _streamed(N.verdicts(_nightly(spark, sf_dir), rule, delay="40 days"), "append")
    return out.where("source <> 'clock'").select("source", F.to_date("night").alias("night"), "n", "verdict", F.to_date("since").alias("since"))


@query("t01u_silence_stream", _FOLD_SQL.format(reset="", silent="f.held >= 6 AND (coalesce(b.n, 0) = 0 OR (f.held >= 20 AND b.n < f.held * 0.25))", within="< 7").replace("DATE '2024-03-18'", "DATE '2024-02-09'"))
def t01u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent sources go without a row of theirs, as far as the clock has come."""
    return _decided(spark, sf_dir, N.safety_rule())


@query("t03u_handover_stream", _FOLD_SQL.format(reset="OR verdict = 'vervallen'", silent="f.held >= 6 AND coalesce(b.n, 0) = 0", within="<= 14").replace("DATE '2024-03-18'", "DATE '2024-02-09'"))
def t03u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, N.handover_rule())
