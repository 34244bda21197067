"""The driver tables as an event agenda, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir  # noqa: F401

TODAY, NOW = "2024-01-10", 19 * 60
HOME = (51.5555, 5.0913)
_TYPES = {"BUILDING": "pop", "FURNITURE": "thea", "AUTOMOBILE": "film", "HOUSEHOLD": "museum", "MACHINERY": "festival"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue dimension; it grows with the customers, so the optimizer decides by size whether to broadcast it."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    kind = F.coalesce(*(F.when(F.col("c_mktsegment") == a, b) for a, b in _TYPES.items()))
    k = F.col("c_custkey")
    return out.select(k.alias("v"), F.col("c_name").alias("venue"), F.col("n_name").alias("city"), F.col("r_name").alias("prov"), kind.alias("vtype"), (50.75 + (k * 37 % 270) / 100).alias("lat"), (3.4 + (k * 53 % 380) / 100).alias("lon"))


def agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    date = F.to_date("ts")
    span = F.when(i % 17 == 0, F.date_add(date, (i % 60).cast("int")))
    rows = e.select(
        i.alias("ord"), F.concat(F.lit("s"), i.cast("string")).alias("id"), F.col("user_id").alias("v"), F.concat(F.lit("act "), k).alias("title"),
        date.alias("date"), (F.hour("ts") * 60 + F.minute("ts")).alias("time"), F.col("event_type").alias("genre"), F.col("value").alias("price"), span.alias("end"),
        F.when(i % 11 == 0, "sold").alias("status"), F.date_sub(F.lit(TODAY).cast("date"), (i % 40).cast("int")).alias("first_seen"), F.concat(F.lit("https://www.host"), (i % 7).cast("string"), F.lit(".example/"), k, F.lit("?ref=a")).alias("url"),
    )
    return rows.join(venues(spark, sf_dir), "v")


AGENDA_SQL = """
venue AS (SELECT c_custkey AS v, c_name AS venue, n_name AS city, r_name AS prov,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'pop' WHEN 'FURNITURE' THEN 'thea' WHEN 'AUTOMOBILE' THEN 'film' WHEN 'HOUSEHOLD' THEN 'museum' WHEN 'MACHINERY' THEN 'festival' END AS vtype,
    CAST(50.75 AS DOUBLE) + CAST(c_custkey * 37 % 270 AS DOUBLE) / 100 AS lat, CAST(3.4 AS DOUBLE) + CAST(c_custkey * 53 % 380 AS DOUBLE) / 100 AS lon
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
agenda AS (SELECT event_id AS ord, concat('s', event_id) AS id, user_id AS v, concat('act ', json_extract_string(props, '$.k')) AS title, CAST(ts AS DATE) AS date,
    CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS time, event_type AS genre, value AS price,
    CASE WHEN event_id % 17 = 0 THEN CAST(ts AS DATE) + CAST(event_id % 60 AS INTEGER) END AS "end", CASE WHEN event_id % 11 = 0 THEN 'sold' END AS status,
    DATE '2024-01-10' - CAST(event_id % 40 AS INTEGER) AS first_seen, concat('https://www.host', event_id % 7, '.example/', json_extract_string(props, '$.k'), '?ref=a') AS url,
    venue, city, prov, vtype, lat, lon FROM events JOIN venue ON user_id = v)"""
KM_SQL = "2 * 6371 * asin(sqrt(pow(sin((radians(lat) - radians(CAST(51.5555 AS DOUBLE))) / 2), 2) + cos(radians(CAST(51.5555 AS DOUBLE))) * cos(radians(lat)) * pow(sin((radians(lon) - radians(CAST(5.0913 AS DOUBLE))) / 2), 2)))"
TYPE_SQL = "CASE WHEN genre = 'Film' AND vtype <> 'festival' THEN 'film' WHEN genre = 'Tentoonstelling' AND vtype <> 'festival' THEN 'expo' WHEN vtype = 'thea' THEN 'thea' WHEN vtype = 'film' THEN 'film' WHEN vtype = 'museum' THEN 'expo' WHEN vtype = 'festival' THEN 'fest' ELSE 'pop' END"
CAR_SQL = f"CASE WHEN {KM_SQL} < 3 THEN CAST(floor({KM_SQL} * 4 + 5 + 0.5) AS INTEGER) ELSE CAST(floor({KM_SQL} * 1.2 / 90 * 60 + 10 + 0.5) AS INTEGER) END"
ENRICHED_SQL = f"""
{AGENDA_SQL},
enriched AS (SELECT *, greatest(0, date_diff('day', DATE '{TODAY}', date)) AS d, date_diff('day', DATE '{TODAY}', "end") AS end_d, date < DATE '{TODAY}' AS started,
    {TYPE_SQL} AS type, greatest(0, date_diff('day', first_seen, DATE '{TODAY}')) AS age, {CAR_SQL} AS car, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS ak
    FROM agenda WHERE coalesce("end", date) >= DATE '{TODAY}')"""
