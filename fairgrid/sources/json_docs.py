"""Nested JSON listings to raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy, text, times
from ..functions.schemas import JSON_DOCS
from .ordered import in_order


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the declared schema, and ``seq`` in the order of files and lines."""
    return in_order(spark.read.schema(JSON_DOCS).json(path))


def event_date(dates: Column, following: Column, start: Column, tz: str) -> Column:
    """The next occurrence's local date: the first of the three that parses."""
    return times.local_date(F.coalesce(times.parse_iso(dates), times.parse_iso(following), times.parse_iso(start)), tz)


def occurrences(tz: str) -> Column:
    """array of (start_at, end_at, all_day) by the first way of telling time that works.

    Columns d (local date), startTime, endTime, times, startDate, endDate: clock
    fields, then "From .. to ..", then weekdays in the series' dates, then all day.
    """
    d, said = F.col("d"), F.col("times_text")

    def one(start: Column, end: Column, all_day: bool) -> Column:
        return F.array(F.struct(start.alias("start_at"), end.alias("end_at"), F.lit(all_day).alias("all_day")))

    clock, until = times.parse_hms(F.col("startTime")), times.parse_hms(F.col("endTime"))
    a, b = times.from_to(said)
    first, last = (times.local_date(times.parse_iso(F.col(c)), tz) for c in ("startDate", "endDate"))
    weekly = F.coalesce(times.weekday_occurrences(said, first, last), F.array().cast("array<struct<d:date,start:int,end:int>>"))

    def each(x: Column) -> Column:
        start, end = times.span(x["d"], x["start"], x["end"], tz)
        return F.struct(start.alias("start_at"), end.alias("end_at"), F.lit(False).alias("all_day"))

    return (
        F.when(clock.isNotNull(), one(*times.span(d, clock, until, tz), False))
        .when(a.isNotNull(), one(*times.span(d, a, b, tz), False))
        .when(F.size(weekly) > 0, F.transform(weekly, each))
        .otherwise(one(times.local_midnight(d, tz), F.lit(None).cast("timestamp"), True))
    )


def raw_events(docs: DataFrame, source_name: str, default_url: str, tz: str = times.HOME, window: tuple[str, str] | None = None) -> DataFrame:
    """One row per occurrence, place its number in the document. Documents without a title or a date go; ``window`` keeps local event dates between two dates, both included."""
    docs = docs.withColumn("title", text.strip("title")).where(F.coalesce(F.col("title"), F.lit("")) != "")
    docs = docs.withColumn("d", event_date(F.col("dates.eventDate"), F.col("nextDate"), F.col("startDate"), tz)).where("d is not null")
    if window:
        docs = docs.where(F.col("d").between(*(F.lit(w).cast("date") for w in window)))
    docs = docs.withColumn("times_text", text.strip(F.coalesce("times", F.lit(""))))
    body = text.blank_as_null(text.clean_html(F.coalesce(text.first_filled(F.col("description"), F.col("teaser")), F.lit(""))))
    docs = docs.withColumn("body", body).select("*", F.posexplode(occurrences(tz)).alias("place", "o"))
    start = F.col("o.start_at")
    return docs.select(
        "seq",
        "title",
        start.alias("start_at"),
        times.local_date(start, tz).alias("start_local_date"),
        F.lit(source_name).alias("source_name"),
        F.coalesce(text.first_filled(F.col("absoluteUrl"), F.col("url")), F.lit(default_url)).alias("source_url"),
        F.when(F.col("o.all_day"), text.all_day_description(F.col("times_text"), F.col("body"))).otherwise(F.col("body")).alias("description"),
        F.col("o.end_at").alias("end_at"),
        text.blank_as_null(text.strip("location")).alias("venue_name"),
        text.address_line(*(F.col(c) for c in ("address1", "city", "state", "zip"))).alias("venue_address"),
        text.blank_as_null(F.try_element_at("media_raw", F.lit(1))["mediaurl"]).alias("image_url"),
        taxonomy.map_categories(F.col("categories.catName")).alias("categories"),
        F.col("o.all_day").alias("all_day"),
        "place",
    )
