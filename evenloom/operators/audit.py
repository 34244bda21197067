"""Quality checks of a snapshot: each finds suspicious venues or sources and gives up to three examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import bare_key

CLUB_GENRES = ("Dance", "Feest")


def _check(rows: DataFrame, name: str, by: str = "venue", example: Column | str = "title", least: int = 1, n: Column | None = None) -> DataFrame:
    example = F.col(example) if isinstance(example, str) else example
    each = rows.groupBy(by, example.alias("_ex")).agg(F.count("*").alias("_k"))
    # an example's place is known before any list is made: a subject never gathers more than three
    first = each.where("_ex is not null").withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_ex"))).where("_r <= 3")
    shown = first.groupBy(by).agg(F.array_sort(F.collect_list("_ex")).alias("x"))
    out = each.groupBy(by).agg(F.sum("_k").alias("n")).where(F.col("n") >= least).join(shown, by, "left")
    return out.select(F.lit(name).alias("check"), F.col(by).cast("string").alias("subject"), "n", F.coalesce(F.array_join("x", "; "), F.lit("")).alias("examples"))


def mostly_sold(events: DataFrame) -> DataFrame:
    """Venues with five or more events of which over 60 % are sold out."""
    out = events.groupBy("venue").agg(F.count("*").alias("all"), F.count_if(F.col("status") == "sold").alias("n")).where((F.col("all") >= 5) & (F.col("n") > 0.6 * F.col("all")))
    return out.select(F.lit("mostly_sold").alias("check"), F.col("venue").alias("subject"), "n", F.lit("").alias("examples"))


def crowded_slots(events: DataFrame, most: int = 3) -> DataFrame:
    """Venues with more than ``most`` events at one date and time, films and festivals aside."""
    rows = events.where(F.col("time").isNotNull() & ~F.col("vtype").isin("film", "festival"))
    slots = rows.groupBy("venue", "date", "time").agg(F.count("*").alias("k")).where(F.col("k") > most)
    return _check(slots, "crowded_slots", example=F.col("date").cast("string"))


def heading_titles(events: DataFrame, pattern: str) -> DataFrame:
    return _check(events.where(F.col("title").rlike(pattern)), "heading_titles")


def venue_titles(events: DataFrame) -> DataFrame:
    return _check(events.where((bare_key("title") == bare_key("venue")) & ~F.col("vtype").isin("festival", "museum")), "venue_titles")


def far_dates(events: DataFrame, today: str, days: int = 400) -> DataFrame:
    return _check(events.where(F.datediff("date", F.lit(today).cast("date")) > days), "far_dates")


def long_periods(events: DataFrame, days: int = 31) -> DataFrame:
    return _check(events.where(~F.col("vtype").isin("festival", "museum") & (F.datediff("end", "date") > days)), "long_periods")


def odd_times(events: DataFrame, before: int = 9 * 60) -> DataFrame:
    return _check(events.where((F.col("time") < before) & ~F.col("genre").isin(*CLUB_GENRES)), "odd_times")


def duplicates(events: DataFrame) -> DataFrame:
    """Venues with several events of one date, time and bare title."""
    rows = events.withColumn("k", bare_key("title")).groupBy("venue", "date", "time", "k").agg(F.count("*").alias("c"), F.min("title").alias("title")).where("c > 1")
    return _check(rows, "duplicates")


def without_coordinates(events: DataFrame) -> DataFrame:
    return _check(events.where(F.col("lat").isNull()), "without_coordinates", example="city")


def empty_sources(sources: DataFrame) -> DataFrame:
    """sources(source, n, previous, late, codes): sources without items."""
    return sources.where("n = 0").select(F.lit("empty_sources").alias("check"), F.col("source").alias("subject"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("examples"))


def sharp_drops(sources: DataFrame) -> DataFrame:
    return sources.where("previous >= 6 and n > 0 and n < previous * 0.5").select(F.lit("sharp_drops").alias("check"), F.col("source").alias("subject"), F.col("n").cast("bigint").alias("n"), F.concat_ws(" ", F.lit("was"), "previous").alias("examples"))


def late_sources(sources: DataFrame) -> DataFrame:
    return sources.where("late").select(F.lit("late_sources").alias("check"), F.col("source").alias("subject"), F.col("n").cast("bigint").alias("n"), F.lit("").alias("examples"))


def refused_sources(sources: DataFrame) -> DataFrame:
    """Sources with answers 403 or 404 among their response codes (map code -> count)."""
    bad = F.coalesce(F.try_element_at("codes", F.lit("403")), F.lit(0)) + F.coalesce(F.try_element_at("codes", F.lit("404")), F.lit(0))
    total = F.aggregate(F.map_values("codes"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sources.where(bad > 0).select(F.lit("refused_sources").alias("check"), F.col("source").alias("subject"), bad.cast("bigint").alias("n"), F.concat_ws(" ", F.lit("van"), total).alias("examples"))


def audit(events: DataFrame, today: str) -> DataFrame:
    checks = [mostly_sold(events), crowded_slots(events), venue_titles(events), far_dates(events, today), long_periods(events), odd_times(events), duplicates(events), without_coordinates(events)]
    return reduce(DataFrame.unionByName, checks)


def summary(now: DataFrame, before: DataFrame, top: int = 4) -> DataFrame:
    """Checks with their totals against an older audit's, the largest first."""
    a = now.groupBy("check").agg(F.sum("n").alias("n"))
    b = before.groupBy("check").agg(F.sum("n").alias("was"))
    return a.join(b, "check", "left").select("check", "n", (F.col("n") - F.coalesce("was", F.lit(0))).alias("delta")).orderBy(F.desc("n"), "check").limit(top)


def markdown(checks: DataFrame, lines: int = 15) -> DataFrame:
    """(check, section): a Markdown section for each check with at most ``lines`` lines, the most affected first."""
    ranked = checks.withColumn("r", F.row_number().over(Window.partitionBy("check").orderBy(F.desc("n"), "subject"))).where(F.col("r") <= lines)
    line = F.concat(F.lit("- "), "subject", F.lit(": "), F.col("n").cast("string"), F.when(F.col("examples") != "", F.concat(F.lit(" ("), "examples", F.lit(")"))).otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n")
    return ranked.groupBy("check").agg(F.concat(F.lit("## "), F.first("check"), F.lit("\n"), body).alias("section"))


def report(checks: DataFrame, order: tuple[str, ...], lines: int = 15, most: int = 60_000) -> DataFrame:
    """(report, n_chars): one Markdown document of the checks in the given order, cut at ``most`` characters.

    A section has its number of subjects, the most affected ``lines`` of them and how many more there are. The cut is a
    running sum over the lines: those that begin within the budget stay, the last one up to it, and a mark follows. The
    document is small by its line limit: len(order) * (lines + 3) lines at most.
    """
    place = F.array_position(F.array(*(F.lit(c) for c in order)), F.col("check"))
    ranked = checks.withColumns({"s": place, "r": F.row_number().over(Window.partitionBy("check").orderBy(F.desc("n"), "subject"))}).where("s > 0")
    counts = ranked.groupBy("check", "s").agg(F.count("*").alias("k"))
    line = F.concat(F.lit("- "), "subject", F.lit(": "), F.col("n").cast("string"), F.lit("×"), F.when(F.col("examples") != "", F.concat(F.lit(", bv. "), "examples")).otherwise(""))
    body = ranked.where(F.col("r") <= lines).select("s", F.col("r").cast("long").alias("r"), line.alias("line"))
    head = counts.select("s", F.lit(0).cast("long").alias("r"), F.concat(F.lit("### "), "check", F.lit(" ("), F.col("k").cast("string"), F.lit(")")).alias("line"))
    more = counts.where(F.col("k") > lines).select("s", F.lit(lines + 1).cast("long"), F.concat(F.lit("- … en nog "), (F.col("k") - lines).cast("string")))
    rows = head.union(body).union(more).union(counts.select("s", F.lit(lines + 2).cast("long"), F.lit("")))
    ends = F.sum(F.length("line") + 1).over(Window.orderBy("s", "r"))  # a bounded number of lines
    placed = rows.withColumn("begins", ends - F.length("line") - 1).withColumn("kept", F.left("line", F.lit(most) - F.col("begins")))
    out = placed.where(F.col("begins") <= most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "r", "kept"))), lambda x: x["kept"]), "\n").alias("text"))
    total = rows.agg((F.sum(F.length("line") + 1) - 1).alias("n_chars"))  # one row
    cut = F.when(F.col("n_chars") > most, F.concat(F.left("text", F.lit(most)), F.lit("\n\n… (afgekapt)"))).otherwise(F.col("text"))
    return out.crossJoin(F.broadcast(total)).select(F.coalesce(cut, F.lit("")).alias("report"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))


def source_report(events: DataFrame, responses: DataFrame) -> DataFrame:
    """events(source), responses(source, code) -> (source, items, codes map)."""
    codes = responses.groupBy("source", "code").agg(F.count("*").alias("k")).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("code").cast("string"), "k")))).alias("codes"))
    return events.groupBy("source").agg(F.count("*").alias("items")).join(codes, "source", "full").select("source", F.coalesce("items", F.lit(0)).alias("items"), "codes")
