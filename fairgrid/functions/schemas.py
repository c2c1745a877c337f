"""Column types of the event tables. Readers and writers use these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RAW = "seq long, title string, start_at timestamp, start_local_date date, source_name string, source_url string, description string, end_at timestamp, venue_name string, venue_address string, image_url string, categories array<string>, all_day boolean"
EVENTS = "event_id string, title string, description string, start_at timestamp, end_at timestamp, venue_name string, venue_address string, latitude double, longitude double, categories array<string>, image_url string, all_day boolean, canonical_hash string, status string, created_at timestamp, updated_at timestamp"
EVENT_SOURCES = "event_id string, source_name string, source_url string, last_seen_at timestamp, is_active boolean, created_at timestamp"
VENUE_GEOCODES = "lookup_key string, latitude double, longitude double, display_name string, status string, geocoder string, geocoded_at timestamp, attempts int"
JSON_DOCS = (
    "title string, description string, teaser string, location string, address1 string, city string, state string, zip string, "
    "startDate string, endDate string, nextDate string, dates struct<eventDate: string>, startTime string, endTime string, times string, "
    "categories array<struct<catName: string>>, media_raw array<struct<mediaurl: string>>, absoluteUrl string, url string"
)
RSS_ITEMS = "title string, link string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
