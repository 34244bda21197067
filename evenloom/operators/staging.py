"""Staging of items of any shape: values are tested by their JSON type before any rule reads them.

Whatever comes in is a variant. A field counts only in the type that it should have (true is no number, a number is no
title); one of another type is as good as absent. An item that can't be kept goes to quarantine with the first rule that
it breaks, as does what is no object or lies beyond the row limit, and never costs its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import let
from .clean import ID, MAX_EVENTS, VENUE_ID, VENUE_TYPES, clock, number, sanitize, valid_date, web_url

#: Reasons for leaving an item out, in the order in which they are tested.
REASONS = ("te veel items", "geen object", "id", "podium-id", "titel", "datum", "onbekend podium")
SOURCE_REASONS = ("titel, datum of url ontbreekt", "ongeldige datum")


def member(item: Column, name: str) -> Column:
    """A member of an object as a variant; null where there is none, or no object."""
    return F.try_variant_get(item, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def is_object(v: Column) -> Column:
    return kind(v).startswith("OBJECT")


def text(v: Column) -> Column:
    """A JSON string, else null."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def numeric(v: Column) -> Column:
    """A JSON number, else null; true and false are none."""
    return F.when(kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))


def items_of(v: Column) -> Column:
    """The items of a JSON list, else null."""
    return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files -> (path, document): each parsed as JSON of any shape, null where it is none."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("document"))


def document_items(documents: DataFrame, key: str, name: str = "events") -> DataFrame:
    """(key, ord, item): the items of a document's list ``name``, in order."""
    return documents.select(key, F.posexplode(items_of(member(F.col("document"), name))).alias("ord", "item"))


def document_venues(documents: DataFrame, key: str) -> DataFrame:
    """(key, v, name, city, prov, type, lat, lon) of a document's venues that have a usable id and name."""
    rows = documents.select(key, F.explode(F.try_variant_get("document", "$.venues", "map<string,variant>")).alias("v", "venue"))
    of = lambda n: member(F.col("venue"), n)
    named = rows.where(F.col("v").rlike(VENUE_ID)).select(
        key, "v", sanitize(text(of("name")), 100).alias("name"), *(F.coalesce(sanitize(text(of(n)), size), F.lit("")).alias(n) for n, size in (("city", 100), ("prov", 60))),
        F.when(text(of("type")).isin(*VENUE_TYPES), text(of("type"))).otherwise("pop").alias("type"), number(numeric(of("lat")), -90, 90, 5).alias("lat"), number(numeric(of("lon")), -180, 180, 5).alias("lon"),
    )
    return named.where("name is not null")


def _kept(values: Column) -> Column:
    """The array without its nulls; null if nothing is left."""
    return let(F.filter(values, lambda x: x.isNotNull()), lambda a: F.when(F.size(a) > 0, a))


def staged(items: DataFrame, venues: DataFrame, key: str, today: str, most: int = MAX_EVENTS) -> DataFrame:
    """items(key, ord, item) -> every item's cleaned fields and ``reason``, null if it stays; venues(key, v) are the known ones.

    ``most`` is the row limit of a document; ord counts from 0. Lists are cut at 8 texts (12 times) before their bad
    entries go; further venues must be known others. No row is lost: in is accepted and quarantine together.
    """
    t = F.lit(today).cast("date")
    of = lambda n: member(F.col("item"), n)
    date = valid_date(text(of("date")), last=F.date_add(t, 1464))
    end = valid_date(text(of("end")), last=F.date_add(t, 10_980))
    support = _kept(F.transform(F.slice(items_of(of("support")), 1, 8), lambda x: sanitize(text(x), 80)))
    time = lambda x: let(F.struct(sanitize(text(member(x, "a")), 80).alias("a"), clock(text(member(x, "s"))).alias("s")), lambda y: F.when(y["a"].isNotNull() & y["s"].isNotNull(), y))
    times = _kept(F.transform(F.slice(items_of(of("times")), 1, 12), time))
    v = F.when(text(of("v")).rlike(VENUE_ID), text(of("v")))
    other = lambda x: let(text(member(x, "v")), lambda o: F.when(o.rlike(VENUE_ID) & (o != v), F.struct(o.alias("v"), web_url(F.coalesce(text(member(x, "url")), F.lit(""))).alias("url"))))
    rows = items.select(
        key, "ord", is_object(F.col("item")).alias("object"), F.when(text(of("id")).rlike(ID), text(of("id"))).alias("id"), v.alias("v"), sanitize(text(of("title")), 200).alias("title"), date.alias("date"), clock(text(of("time"))).alias("time"),
        web_url(F.coalesce(text(of("url")), F.lit(""))).alias("url"), F.coalesce(sanitize(text(of("genre")), 40), F.lit("Overig")).alias("genre"), valid_date(text(of("first_seen")), last=F.date_add(t, 1464)).alias("first_seen"), number(numeric(of("price")), 0, 10_000, 2).alias("price"),
        *(clock(text(of(n))).alias(n) for n in ("doors", "start", "tot")), F.when(text(of("status")) == "sold", "sold").alias("status"), F.when(end >= date, end).alias("end"), support.alias("support"), number(numeric(of("dur")), 1, 1441).alias("dur"), times.alias("times"),
        F.when((kind(of("kids")) == "BOOLEAN") & F.try_variant_get(of("kids"), "$", "boolean"), True).alias("kids"), _kept(F.transform(F.slice(items_of(of("ook")), 1, 8), other)).alias("ook"),
    )
    known = venues.select(key, "v").distinct()
    rows = rows.join(known.withColumn("known", F.lit(True)), [key, "v"], "left")
    # further venues by a join as well: only rows that name any travel
    named = rows.where("ook is not null").select(key, "ord", F.posexplode("ook").alias("place", "o")).withColumn("other", F.col("o.v"))
    others = named.join(known.withColumnRenamed("v", "other"), [key, "other"])
    others = others.groupBy(key, "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "o"))), lambda x: x["o"]).alias("ook"))
    rows = rows.drop("ook").join(others, [key, "ord"], "left")
    broken = (F.col("ord") >= most, ~F.col("object"), F.col("id").isNull(), F.col("v").isNull(), F.col("title").isNull(), F.col("date").isNull(), F.col("known").isNull())
    return rows.withColumn("reason", F.coalesce(*(F.when(b, r) for b, r in zip(broken, REASONS)))).drop("object", "known")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def quarantine(rows: DataFrame, key: str) -> DataFrame:
    """(key, reason, n) of what was left out."""
    return rows.where("reason is not null").groupBy(key, "reason").agg(F.count("*").alias("n"))


def source_items(items: DataFrame) -> DataFrame:
    """Items of source readers (source, place, item) -> typed (title, date, url, time, doors, start, tot, end, item) with ``reason``.

    Title, date and url must be texts, the title not blank and the date one up to 2100; a time or end that is none goes.
    """
    of = lambda n: member(F.col("item"), n)
    far = F.lit("2100-01-01").cast("date")
    there = (F.trim(text(of("title"))) != "") & text(of("date")).isNotNull() & text(of("url")).isNotNull()
    rows = items.select(
        "source", "place", text(of("title")).alias("title"), valid_date(text(of("date")), last=far).alias("date"), text(of("url")).alias("url"), *(clock(text(of(n))).alias(n) for n in ("time", "doors", "start", "tot")),
        valid_date(text(of("end")), last=far).alias("end"), "item", F.coalesce(there, F.lit(False)).alias("there"),
    )
    return rows.withColumn("reason", F.when(~F.col("there"), SOURCE_REASONS[0]).when(F.col("date").isNull(), SOURCE_REASONS[1])).drop("there")
