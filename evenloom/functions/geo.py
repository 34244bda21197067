"""Distance and travel time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(x if isinstance(x, Column) else F.lit(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(h))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def travel(k: Column) -> Column:
    """Struct of minutes by car, public transport, foot and bike for k kilometres as the crow flies, and the mode to show."""
    near = k < 3
    return F.when(
        k.isNotNull(),
        F.struct(
            half_up(F.when(near, k * 4 + 5).otherwise(k * 1.2 / 90 * 60 + 10)).alias("car"),
            half_up(F.when(near, k * 6 + 8).otherwise(k * 1.2 / 70 * 60 + 15)).alias("transit"),
            F.when(near, F.greatest(F.lit(2), half_up(k * 1.3 * 12))).alias("walk"),
            F.when(k < 15, half_up(k * 1.3 * 4 + 2)).alias("bike"),
            F.when(k < 1.2, "walk").when(k < 6, "bike").otherwise("car").alias("mode"),
        ),
    )


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Degrees clockwise from north."""
    a, b, c, d = (F.radians(x if isinstance(x, Column) else F.lit(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(d - b) * F.cos(c)
    x = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))
