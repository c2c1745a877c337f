"""Calendar exports: iCalendar text, share text, calendar links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text, times

PRODUCT, DOMAIN = "-//fairgrid//Events//EN", "fairgrid"


def _end(end: Column, start: Column, all_day: Column) -> Column:
    return F.when(all_day, F.coalesce(end, start + F.expr("interval 1 day"))).otherwise(F.coalesce(end, start))


def first_url() -> Column:
    return F.try_element_at("sources", F.lit(1))["source_url"]


def ical_content(stamp: Column, product: str = PRODUCT, domain: str = DOMAIN) -> Column:
    """An event row with ``sources`` to a whole calendar file, lines ended by CR LF; empty properties are left out."""
    all_day, start = F.col("all_day"), F.col("start_at")
    end = _end(F.col("end_at"), start, all_day)
    when_ = lambda name, t: F.when(all_day, F.concat(F.lit(f"{name};VALUE=DATE:"), times.utc_date_text(t))).otherwise(F.concat(F.lit(f"{name}:"), times.utc_time_text(t)))
    filled = lambda name, c: F.concat(F.lit(f"{name}:"), text.escape_ical(text.blank_as_null(c)))
    return F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0"),
        F.lit(f"PRODID:{product}\r\nBEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("event_id"), F.lit(f"@{domain}")),
        F.concat(F.lit("DTSTAMP:"), times.utc_time_text(stamp)),
        when_("DTSTART", start),
        when_("DTEND", end),
        F.concat(F.lit("SUMMARY:"), text.escape_ical(F.col("title"))),
        filled("DESCRIPTION", F.col("description")),
        filled("LOCATION", text.location_label(F.col("venue_name"), F.col("venue_address"))),
        F.concat(F.lit("URL:"), text.blank_as_null(first_url())),
        F.lit("END:VEVENT\r\nEND:VCALENDAR"),
    )


def share_text(tz: str = times.HOME) -> Column:
    """Title, long date and time, place, description and first address, in lines."""
    day = F.date_format(times.local(F.col("start_at"), tz), "EEEE, MMMM d, yyyy")
    clock = F.when(F.col("all_day"), "All day").otherwise(times.time_range_text(F.col("start_at"), F.col("end_at"), tz))
    gap = lambda c: F.concat(F.lit("\n"), text.blank_as_null(c))
    return F.concat_ws("\n", text.blank_as_null(F.col("title")), F.concat_ws(" · ", day, clock), text.blank_as_null(text.location_label(F.col("venue_name"), F.col("venue_address"))), gap(F.col("description")), gap(first_url()))


def calendar_link(base: str = "https://calendar.google.com/calendar/render") -> Column:
    all_day, start = F.col("all_day"), F.col("start_at")
    end = _end(F.col("end_at"), start, all_day)
    fmt = lambda t: F.when(all_day, times.utc_date_text(t)).otherwise(times.utc_time_text(t))
    values = {"text": F.col("title"), "dates": F.concat(fmt(start), F.lit("/"), fmt(end)), "details": F.coalesce("description", F.lit("")), "location": text.location_label(F.col("venue_name"), F.col("venue_address"))}
    return F.concat(F.lit(f"{base}?action=TEMPLATE"), *[x for k, v in values.items() for x in (F.lit(f"&{k}="), F.url_encode(v))])
