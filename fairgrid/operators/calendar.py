"""Per-day calendars: which events a day shows, in which group, with filters, histograms, pins and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy, times
from .numbering import dense

BUCKETS = ("allday", "morning", "afternoon", "evening", "night")
#: The histogram's display order of hours.
HOUR_ORDER = [*range(5, 24), *range(0, 5)]


def on_day(events: DataFrame, day: str, tz: str = times.HOME) -> DataFrame:
    """Active events whose local days, first to last, hold ``day``."""
    d = F.lit(day).cast("date")
    start, end = times.local_date(F.col("start_at"), tz), times.local_date(F.coalesce("end_at", "start_at"), tz)
    return events.where((F.col("status") == "active") & (start <= d) & (end >= d))


def event_days(events: DataFrame, first: str | None = None, last: str | None = None, tz: str = times.HOME) -> DataFrame:
    """Active events once for each local day they are on, as ``day``; days are clipped to the range before they are made."""
    start, end = times.local_date(F.col("start_at"), tz), times.local_date(F.coalesce("end_at", "start_at"), tz)
    lo = F.greatest(start, F.lit(first).cast("date")) if first else start
    hi = F.least(end, F.lit(last).cast("date")) if last else end
    rows = events.where("status = 'active'").withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    return rows.withColumn("day", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def category_filter(categories: Column, selected: list[str] = taxonomy.DEFAULT_SELECTED, include_untagged: bool = True) -> Column:
    """One selected tag suffices; events without tags follow ``include_untagged``."""
    untagged = F.coalesce(F.size(categories), F.lit(0)) <= 0
    chosen = F.array(*map(F.lit, selected)).cast("array<string>")
    return F.when(untagged, F.lit(include_untagged)).otherwise(F.coalesce(F.arrays_overlap(categories, chosen), F.lit(False)))


def venue_filter(venue: Column, hidden: list[str]) -> Column:
    """Not hidden; with anything hidden, events without a venue go too."""
    return F.coalesce((venue != "") & ~venue.isin(hidden), F.lit(False)) if hidden else F.lit(True)


def without_venues(events: DataFrame, hidden: DataFrame) -> DataFrame:
    """The same for a table (venue_name) of hidden venues, however long."""
    return events.where("venue_name is not null and venue_name != ''").join(hidden.select("venue_name"), "venue_name", "left_anti")


def has_location() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def starts_before(day: Column, tz: str = times.HOME) -> Column:
    return times.local_date(F.col("start_at"), tz) < day


def crosses_night(day: Column, tz: str = times.HOME) -> Column:
    """Began before the day and ends on it before 3 o'clock: it belongs to the night before."""
    ends = (times.local_date(F.col("end_at"), tz) == day) & (times.local_hour(F.col("end_at"), tz) < 3)
    return starts_before(day, tz) & F.coalesce(ends, F.lit(False))


def with_groups(days: DataFrame, tz: str = times.HOME) -> DataFrame:
    """Adds ``bucket``, one of BUCKETS or "dropped", and ``hour``, the local start hour of what isn't all day."""
    day = F.col("day")
    all_day = times.is_all_day(F.col("all_day"), F.col("start_at"), F.col("end_at"), day, tz)
    hour = times.local_hour(F.col("start_at"), tz)
    bucket = F.when(all_day, "allday").when(crosses_night(day, tz), "dropped").when(starts_before(day, tz), "allday").otherwise(times.bucket_of(hour))
    return days.withColumn("bucket", bucket).withColumn("hour", F.when(~F.col("bucket").isin("allday", "dropped"), hour))


def hour_histogram(grouped: DataFrame) -> DataFrame:
    """(day, hour, n) for all 24 hours of every day that has events."""
    counts = grouped.groupBy("day", "hour").agg(F.count("*").alias("n"))
    every = counts.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return every.join(counts.where("hour is not null"), ["day", "hour"], "left").select("day", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def bar_heights(histogram: DataFrame) -> DataFrame:
    """Adds ``height`` (percent of the day's largest, 6 at least where there is anything) and ``place`` in the display order; days without counts go."""
    day = Window.partitionBy("day")
    top, whole = F.max("n").over(day), F.sum("n").over(day)
    place = F.when(F.col("hour") >= 5, F.col("hour") - 5).otherwise(F.col("hour") + 19)
    height = F.when(F.col("n") > 0, F.greatest(F.lit(6.0), F.col("n") / F.greatest(F.lit(1), top) * 100)).otherwise(0.0)
    return histogram.withColumns({"height": height, "place": place, "whole": whole}).where("whole > 0").drop("whole")


def bucket_counts(grouped: DataFrame) -> DataFrame:
    """(day, allday, morning, afternoon, evening, night)."""
    return grouped.groupBy("day").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])


def hour_groups(grouped: DataFrame) -> DataFrame:
    """(day, bucket, hour, label, event_ids, n): a bucket's events by local start hour, in the order of their starts."""
    listed = F.array_sort(F.collect_list(F.struct("start_at", "event_id")))
    some = grouped.where("hour is not null").groupBy("day", "bucket", "hour").agg(listed.alias("l"))
    return some.select("day", "bucket", "hour", times.hour_label(F.col("hour"), True).alias("label"), F.transform("l", lambda x: x["event_id"]).alias("event_ids"), F.size("l").alias("n"))


def pins(days: DataFrame) -> DataFrame:
    """(day, pin, n, latitude, longitude, event_id): events at one coordinate of five decimals, with the first one's place."""
    key = F.format_string("%.5f,%.5f", "latitude", "longitude")
    first = F.min_by(F.struct("latitude", "longitude", "event_id"), F.struct("start_at", "event_id"))
    got = days.where(has_location()).groupBy("day", key.alias("pin")).agg(F.count("*").alias("n"), first.alias("first"))
    return got.select("day", "pin", "n", "first.*")


def pin_events(days: DataFrame, most: int | None = None) -> DataFrame:
    """(day, pin, place, event_id): all events of each pin in start order, or the first ``most`` of each."""
    key = F.format_string("%.5f,%.5f", "latitude", "longitude")
    place = F.row_number().over(Window.partitionBy("day", "pin").orderBy("start_at", "event_id"))
    out = days.where(has_location()).withColumn("pin", key).withColumn("place", place).select("day", "pin", "place", "event_id")
    return out if most is None else out.where(F.col("place") <= most)


def venues(days: DataFrame) -> DataFrame:
    """(day, venue_name): the distinct, non-empty venues of each day."""
    return days.where("venue_name is not null and venue_name != ''").select("day", "venue_name").distinct()


def visible_counts(days: DataFrame, visible: Column) -> DataFrame:
    return days.groupBy("day").agg(F.count("*").alias("total"), F.count_if(visible).alias("visible"), F.count_if(~visible).alias("hidden"))


def source_rank(name: Column, priority: list[str]) -> Column:
    """Place in the priority list; unlisted names come after all of it."""
    listed = F.array(*map(F.lit, priority)).cast("array<string>")
    at = F.coalesce(F.array_position(listed, name), F.lit(0))
    return F.when(at > 0, at).otherwise(len(priority) + 1).cast("int")


def with_sources(events: DataFrame, sources: DataFrame, priority: list[str]) -> DataFrame:
    """Adds ``sources``, array of (source_name, source_url): listed sources first, then by name; inactive ones too. One row per event meets the join."""
    ranked = F.array_sort(F.collect_list(F.struct(source_rank(F.col("source_name"), priority).alias("rank"), "source_name", "source_url")))
    per = sources.groupBy("event_id").agg(F.transform(ranked, lambda s: F.struct(s["source_name"].alias("source_name"), s["source_url"].alias("source_url"))).alias("sources"))
    none = F.array().cast("array<struct<source_name:string,source_url:string>>")
    return events.join(per, "event_id", "left").withColumn("sources", F.coalesce("sources", none))


def by_start(days: DataFrame) -> DataFrame:
    return days.orderBy("day", "start_at", "event_id")


def placed(days: DataFrame) -> DataFrame:
    """Adds ``place``, from 1 in each day by start and id; numbered over the whole table, so that no task holds a day."""
    n = dense(days, ["day", "start_at", "event_id"], "n")
    first = n.groupBy("day").agg(F.min("n").alias("first"))
    return n.join(first, "day").withColumn("place", F.col("n") - F.col("first") + 1).drop("n", "first")


def day_counts(events: DataFrame, flags: dict[str, Column] | None = None, tz: str = times.HOME) -> DataFrame:
    """(day, n, and a count for each flag) of active events on each day that has any, without a row for each of an event's days.

    An event adds one on its first day and takes it away after its last; the
    changes are summed by day, and running sums over the days give the counts.
    Only a row for each day meets in one task.
    """
    ones = {"n": F.lit(1)} | {name: F.coalesce(flag, F.lit(False)).cast("int") for name, flag in (flags or {}).items()}
    start, end = times.local_date(F.col("start_at"), tz), times.local_date(F.coalesce("end_at", "start_at"), tz)
    on = events.where("status = 'active'").select(start.alias("lo"), end.alias("hi"), *[c.alias(name) for name, c in ones.items()]).where("lo <= hi")
    ends = on.select(F.explode(F.array(F.struct(F.col("lo").alias("day"), F.lit(1).alias("sign")), F.struct(F.date_add("hi", 1).alias("day"), F.lit(-1).alias("sign")))).alias("e"), *ones)
    changes = ends.groupBy(F.col("e.day").alias("day")).agg(*[F.sum(F.col("e.sign") * F.col(name)).alias(name) for name in ones])
    days = Window.orderBy("day")
    sums = changes.select("day", F.lead("day").over(days).alias("next"), *[F.sum(name).over(days).alias(name) for name in ones])
    spans = sums.where("n > 0 and next is not null")
    return spans.select(F.explode(F.sequence("day", F.date_sub("next", 1))).alias("day"), *ones)
