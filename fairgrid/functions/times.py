"""Instants, local days and wall times. Every zone is an argument; the session's zone is taken to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME = "America/Chicago"

#: Weekday names as listings write them, Monday 0.
WEEKDAYS = {"monday": 0, "mon": 0, "tuesday": 1, "tue": 1, "wednesday": 2, "wed": 2, "thursday": 3, "thu": 3, "friday": 4, "fri": 4, "saturday": 5, "sat": 5, "sunday": 6, "sun": 6}

#: The times that listings' texts give.
_CLOCK = r"(\d{1,2}(?::\d{2})?(?:am|pm))"
_DAY_TIMES = rf"(?i)({'|'.join(WEEKDAYS)})\s+{_CLOCK}\s*[-–]\s*{_CLOCK}"
_FROM_TO = r"(?i)From:\s*(\d{1,2}:\d{2}\s*[AP]M)\s*to\s*(\d{1,2}:\d{2}\s*[AP]M)"


def local(ts: Column, tz: str = HOME) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: str = HOME) -> Column:
    return F.to_date(local(ts, tz))


def local_hour(ts: Column, tz: str = HOME) -> Column:
    return F.hour(local(ts, tz))


def local_midnight(d: Column, tz: str = HOME) -> Column:
    """The instant at which a local date begins."""
    return F.to_utc_timestamp(d.cast("timestamp"), tz)


def aware(naive: Column, tz: str = HOME) -> Column:
    """A zone-less time of day in the home zone, or a date's midnight, to an instant."""
    return F.to_utc_timestamp(naive.cast("timestamp"), tz)


def window_bound(d: Column, tz: str = HOME) -> Column:
    """Local midnight as an ISO string in UTC with milliseconds."""
    return F.date_format(local_midnight(d, tz), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(s: Column) -> Column:
    """ISO text to an instant, zone-less text as UTC; null for anything else."""
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(s))


def parse_hms(s: Column) -> Column:
    """Hours:minutes:seconds, all three and in range, to seconds of the day; else null."""
    parts = F.split(s, ":")
    h, m, sec = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    ok = s.rlike(r"^\s*\d+\s*:\s*\d+\s*:\s*\d+\s*$") & (h < 24) & (m < 60) & (sec < 60)
    return F.when(ok, h * 3600 + m * 60 + sec)


def parse_clock(s: Column) -> Column:
    """6:30pm, 6pm to seconds of the day; else null."""
    u = F.upper(F.trim(s))
    t = F.coalesce(F.try_to_timestamp(u, F.lit("h:mma")), F.try_to_timestamp(u, F.lit("ha")))
    return F.hour(t) * 3600 + F.minute(t) * 60


def at_clock(d: Column, seconds: Column, tz: str = HOME) -> Column:
    """Local date and seconds of the day to an instant."""
    naive = F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), F.floor(seconds / 3600).cast("int"), F.floor(seconds / 60).cast("int") % 60, (seconds % 60).cast("decimal(8,6)"))
    return F.to_utc_timestamp(naive.cast("timestamp"), tz)


def span(d: Column, start: Column, end: Column, tz: str = HOME) -> tuple[Column, Column]:
    """Start and end instants on a local date; an end before the start in wall time is on the next day, and may be null."""
    last = F.when(end < start, F.date_add(d, 1)).otherwise(d)
    return at_clock(d, start, tz), F.when(end.isNotNull(), at_clock(last, end, tz))


def from_to(times: Column) -> tuple[Column, Column]:
    """Seconds of the day of "From: 06:00 PM to 08:30 PM"; both null unless both parse."""

    def one(group: int) -> Column:
        text = F.upper(F.regexp_extract(times, _FROM_TO, group))
        spaced = F.when(text.rlike(r"\s"), F.regexp_replace(text, r"\s+", " "))
        t = F.try_to_timestamp(spaced, F.lit("h:mm a"))
        return F.hour(t) * 3600 + F.minute(t) * 60

    a, b = one(1), one(2)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def weekday_occurrences(times: Column, start: Column, end: Column) -> Column:
    """Every "<weekday> t1-t2" on every matching date of [start, end]: array of (d, start, end), dates and seconds, in text order then by date."""
    found = F.regexp_extract_all(times, F.lit(_DAY_TIMES), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in WEEKDAYS.items() for x in pair])
    days = F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))

    def dates(m: Column) -> Column:
        day = F.try_element_at(names, F.lower(F.regexp_extract(m, _DAY_TIMES, 1)))
        a, b = (parse_clock(F.regexp_extract(m, _DAY_TIMES, g)) for g in (2, 3))
        hit = F.filter(days, lambda d: (F.weekday(d) == day) & a.isNotNull() & b.isNotNull())
        return F.transform(hit, lambda d: F.struct(d.alias("d"), a.alias("start"), b.alias("end")))

    return F.flatten(F.transform(F.coalesce(found, F.array().cast("array<string>")), dates))


def bucket_of(hour: Column) -> Column:
    """morning 5-12, afternoon 12-17, evening 17-21, night otherwise."""
    return F.when((hour >= 5) & (hour < 12), "morning").when((hour >= 12) & (hour < 17), "afternoon").when((hour >= 17) & (hour < 21), "evening").otherwise("night")


def is_local_midnight(ts: Column, tz: str = HOME) -> Column:
    return F.date_format(local(ts, tz), "HH:mm") == "00:00"


def is_all_day(all_day: Column, start: Column, end: Column, day: Column, tz: str = HOME) -> Column:
    """By flag; or begun before the day and ending after it; or midnight to nothing, to itself, or to a midnight 24 hours on or more."""
    none = F.lit(False)
    spans = F.coalesce((local_date(start, tz) < day) & (local_date(end, tz) > day), none)
    long = is_local_midnight(end, tz) & (F.unix_timestamp(end) - F.unix_timestamp(start) >= 86400)
    shape = is_local_midnight(start, tz) & (end.isNull() | (end == start) | F.coalesce(long, none))
    return F.coalesce(all_day, none) | spans | F.coalesce(shape, none)


def clock_text(ts: Column, tz: str = HOME) -> Column:
    return F.date_format(local(ts, tz), "h:mm a")


def time_range_text(start: Column, end: Column, tz: str = HOME) -> Column:
    return F.concat_ws(" – ", clock_text(start, tz), clock_text(end, tz))


def hour_label(hour: Column, long: bool = False) -> Column:
    """12a, 5p; long: 12 AM, 5 PM."""
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    return F.concat(twelve, F.when(hour < 12, " AM" if long else "a").otherwise(" PM" if long else "p"))


def utc_date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def utc_time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
