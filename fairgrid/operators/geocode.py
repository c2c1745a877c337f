"""Coordinates for events through a cache of venue lookups, misses against a gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

SEPARATOR = " | "


def lookup_key(name: Column, address: Column, city: str, suffix: str) -> Column:
    """The address in lower case, with ", city, state" unless it names the city; else "name | city, state"; else null."""
    flat = lambda c: F.regexp_replace(F.lower(text.strip(c)), r"(?U)\s+", " ")
    filled = lambda c: F.coalesce(text.strip(c) != "", F.lit(False))
    full = F.when(F.contains(flat(address), F.lit(city)), flat(address)).otherwise(F.concat(flat(address), F.lit(f", {suffix}")))
    return F.when(filled(address), full).when(filled(name), F.concat(flat(name), F.lit(SEPARATOR + suffix)))


def lookup_text(key: Column, suffix: str) -> Column:
    """What a gazetteer is asked for: "name | .." as "name, city, state"."""
    return F.when(F.contains(key, F.lit(SEPARATOR)), F.concat(F.substring_index(key, SEPARATOR, 1), F.lit(f", {suffix}"))).otherwise(key)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """box: left, top, right, bottom."""
    left, top, right, bottom = box
    return lon.between(left, right) & lat.between(bottom, top)


def place_key(lat: Column, lon: Column, bits: int = 16) -> Column:
    """Place on a curve over the globe that keeps neighbours near: bits of longitude and latitude in turn, the highest first."""
    cell = lambda x, span: F.least(F.greatest(F.floor((x / span + 0.5) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    key = F.lit(0).cast("long")
    for c, shift in ((cell(lon, 360.0), 1), (cell(lat, 180.0), 0)):
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), 2 * b + shift))
    return key


def write_by_place(events: DataFrame, path: str) -> None:
    """Parquet files along the curve, so that their statistics tell which of them a box can meet; rows without a place come last."""
    key = place_key(F.col("latitude"), F.col("longitude")).alias("place")
    order = [F.asc_nulls_last("place"), "event_id"]
    events.withColumn("place", key).repartitionByRange(*order).sortWithinPartitions(*order).drop("place").write.parquet(path)


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Events of write_by_place() in a box of left, top, right and bottom; the filter goes to the files' statistics."""
    return spark.read.parquet(path).where(in_box(F.col("latitude"), F.col("longitude"), tuple(map(F.lit, box))))


def missing(events: DataFrame) -> DataFrame:
    """Active, no latitude, something known of the venue."""
    return events.where("status = 'active' and latitude is null and (venue_address is not null or venue_name is not null)")


def of_source(events: DataFrame, sources: DataFrame, source_name: str) -> DataFrame:
    live = sources.where((F.col("source_name") == source_name) & F.col("is_active"))
    return events.join(live.select("event_id"), "event_id", "left_semi")


def usable(cache: DataFrame) -> DataFrame:
    return cache.where("status = 'success' and latitude is not null and longitude is not null")


def without_failures(cache: DataFrame) -> DataFrame:
    """For a forced retry: what didn't succeed is forgotten."""
    return cache.where("status = 'success'")


def look_up(keys: DataFrame, cache: DataFrame, gazetteer: DataFrame, now: str, suffix: str, geocoder: str = "gazetteer") -> DataFrame:
    """Cache rows for the distinct keys it hasn't: success, not_found, or error for a match with bad coordinates.

    gazetteer: (query, lat, lon, display_name) with coordinates as text; the
    smallest display name stands for a query.
    """
    new = keys.select("lookup_key").where("lookup_key is not null").distinct().join(cache.select("lookup_key"), "lookup_key", "left_anti")
    known = gazetteer.groupBy("query").agg(F.min(F.struct("display_name", "lat", "lon")).alias("g"))
    found = new.withColumn("query", lookup_text(F.col("lookup_key"), suffix)).join(known, "query", "left")
    lat, lon = F.col("g.lat").try_cast("double"), F.col("g.lon").try_cast("double")
    good = lat.isNotNull() & lon.isNotNull()
    status = F.when(F.col("g").isNull(), "not_found").when(good, "success").otherwise("error")
    return found.select("lookup_key", F.when(good, lat).alias("latitude"), F.when(good, lon).alias("longitude"), F.when(good, F.col("g.display_name")).alias("display_name"), status.alias("status"), F.lit(geocoder).alias("geocoder"), F.lit(now).cast("timestamp").alias("geocoded_at"), F.lit(0).alias("attempts"))


def attach(events: DataFrame, cache: DataFrame, city: str, suffix: str) -> DataFrame:
    """Coordinates of the cache for events that lack one of the two; adds ``hit``. The join side is left to the size of the cache."""
    key = lookup_key(F.col("venue_name"), F.col("venue_address"), city, suffix)
    open_ = F.col("latitude").isNull() | F.col("longitude").isNull()
    place = usable(cache).select("lookup_key", F.col("latitude").alias("lat_"), F.col("longitude").alias("lon_"))
    out = events.withColumn("lookup_key", F.when(open_, key)).join(place, "lookup_key", "left")
    hit = F.col("lat_").isNotNull()
    out = out.withColumn("hit", hit).withColumns({"latitude": F.when(hit, F.col("lat_")).otherwise(F.col("latitude")), "longitude": F.when(hit, F.col("lon_")).otherwise(F.col("longitude"))})
    return out.drop("lookup_key", "lat_", "lon_")


def stats(attached: DataFrame) -> DataFrame:
    """hits, misses (nothing found, venue known), skipped (no venue)."""
    known = F.coalesce(F.col("venue_name") != "", F.lit(False)) | F.coalesce(F.col("venue_address") != "", F.lit(False))
    return attached.agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit") & known).alias("misses"), F.count_if(~F.col("hit") & ~known).alias("skipped"))


def backfill(events: DataFrame, cache: DataFrame, gazetteer: DataFrame, now: str, city: str, suffix: str, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events with coordinates and hit, new cache, stats with errors and cleared) for all active events that miss them."""
    kept = without_failures(cache) if force else cache
    some = missing(events)
    keys = some.select(lookup_key(F.col("venue_name"), F.col("venue_address"), city, suffix).alias("lookup_key"))
    after = kept.unionByName(look_up(keys, kept, gazetteer, now, suffix))
    got = attach(some, after, city, suffix)
    errors = after.agg(F.count_if(F.col("status") == "error").alias("errors"))
    cleared = cache.agg((F.count_if(F.col("status") != "success") if force else F.lit(0).cast("long")).alias("cleared"))
    return got, after, stats(got).crossJoin(errors).crossJoin(cleared)
