"""Event listings derived from the driver's tables, in Spark and, with the same rows, in SQL for DuckDB.

events.ts is read as UTC. A listing's title, venue, zone-aware times, flags and
categories are arithmetic on its columns, so both engines can evaluate them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy, times

#: The derived city and its lookup suffix.
CITY, SUFFIX = "springfield", "springfield, il"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    i, u = F.col("event_id"), F.col("user_id")
    all_day = i % 11 == 0
    start = F.when(all_day, times.local_midnight(times.local_date(F.col("ts")))).otherwise(F.date_trunc("hour", "ts"))
    e = e.withColumn("start_at", start)
    end = F.when(i % 4 != 0, F.timestamp_seconds(F.unix_timestamp("start_at") + (i % 60) * 3600))
    tag = lambda n: F.element_at(taxonomy.vocabulary(), (n % 15 + 1).cast("int"))
    return e.select(
        i.alias("seq"),
        F.concat("event_type", F.lit(" night "), (u % 10).cast("string")).alias("title"),
        "start_at",
        times.local_date(F.col("start_at")).alias("start_local_date"),
        F.concat(F.lit("Source "), F.when(i % 2 == 0, "A").otherwise("B")).alias("source_name"),
        F.concat(F.lit("https://example.com/"), i.cast("string")).alias("source_url"),
        F.when(i % 3 != 0, F.concat(F.lit("About "), "event_type", F.when(i % 7 == 0, ", free entry").when(i % 7 == 1, ", $5 at the door").otherwise(F.lit("")))).alias("description"),
        end.alias("end_at"),
        F.when(i % 13 != 0, F.concat(F.lit(" Venue "), (u % 25).cast("string"))).alias("venue_name"),
        F.when(i % 5 == 0, F.concat((u % 25).cast("string"), F.lit("  Main St"))).alias("venue_address"),
        F.lit(None).cast("string").alias("image_url"),
        F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(tag(F.col("k")), tag(F.col("k") * 7 + 1))).alias("categories"),
        all_day.alias("all_day"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings as events of their own: one each, a seventeenth of them removed, some without coordinates."""
    r = raw_events(spark, sf_dir)
    n = F.coalesce(F.regexp_extract("venue_name", r"(\d+)", 1).try_cast("int"), F.lit(0))
    there = F.col("seq") % 19 != 0
    return r.select(
        F.lpad(F.col("seq").cast("string"), 9, "0").alias("event_id"), "title", "description", "start_at", "end_at", "venue_name", "venue_address",
        F.when(there, n / 1000 + 43.05).alias("latitude"), F.when(there, n / 500 - 89.4).alias("longitude"), "categories", "image_url", "all_day",
        F.col("seq").cast("string").alias("canonical_hash"), F.when(F.col("seq") % 17 == 0, "removed").otherwise("active").alias("status"),
        F.col("start_at").alias("created_at"), F.col("start_at").alias("updated_at"),
    )


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of every third event, one of the others; a fifth of them inactive."""
    r = raw_events(spark, sf_dir)
    names = F.when(F.col("seq") % 3 == 0, F.array(F.lit("Zeta"), F.lit("Source B"))).otherwise(F.array(F.lit("Source A")))
    return r.select(F.lpad(F.col("seq").cast("string"), 9, "0").alias("event_id"), F.explode(names).alias("source_name"), "source_url", F.col("start_at").alias("last_seen_at"), (F.col("seq") % 5 != 0).alias("is_active"), F.col("start_at").alias("created_at"))


TAGS = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in taxonomy.CATEGORIES) + "]"

#: The same tables for DuckDB: put before a query's own common tables.
SQL = f"""WITH base AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS ld FROM events),
begun AS (
  SELECT *, CASE WHEN event_id % 11 = 0 THEN timezone('UTC', timezone('America/Chicago', CAST(ld AS TIMESTAMP))) ELSE date_trunc('hour', ts) END AS start_at FROM base),
raw AS (
  SELECT event_id AS seq, event_type || ' night ' || CAST(user_id % 10 AS VARCHAR) AS title, start_at,
    CAST(timezone('America/Chicago', timezone('UTC', start_at)) AS DATE) AS start_local_date,
    CASE WHEN event_id % 2 = 0 THEN 'Source A' ELSE 'Source B' END AS source_name,
    'https://example.com/' || CAST(event_id AS VARCHAR) AS source_url,
    CASE WHEN event_id % 3 <> 0 THEN 'About ' || event_type || CASE WHEN event_id % 7 = 0 THEN ', free entry' WHEN event_id % 7 = 1 THEN ', $5 at the door' ELSE '' END END AS description,
    CASE WHEN event_id % 4 <> 0 THEN start_at + (event_id % 60) * INTERVAL 1 HOUR END AS end_at,
    CASE WHEN event_id % 13 <> 0 THEN ' Venue ' || CAST(user_id % 25 AS VARCHAR) END AS venue_name,
    CASE WHEN event_id % 5 = 0 THEN CAST(user_id % 25 AS VARCHAR) || '  Main St' END AS venue_address,
    CASE WHEN k % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [{TAGS}[k % 15 + 1], {TAGS}[(k * 7 + 1) % 15 + 1]] END AS categories,
    event_id % 11 = 0 AS all_day
  FROM begun),
ev AS (
  SELECT lpad(CAST(seq AS VARCHAR), 9, '0') AS event_id, title, description, start_at, end_at, venue_name, venue_address,
    CASE WHEN seq % 19 <> 0 THEN coalesce(TRY_CAST(regexp_extract(venue_name, '([0-9]+)', 1) AS INTEGER), 0) / 1000.0 + 43.05 END AS latitude,
    CASE WHEN seq % 19 <> 0 THEN coalesce(TRY_CAST(regexp_extract(venue_name, '([0-9]+)', 1) AS INTEGER), 0) / 500.0 - 89.4 END AS longitude,
    categories, all_day, CASE WHEN seq % 17 = 0 THEN 'removed' ELSE 'active' END AS status,
    timezone('America/Chicago', timezone('UTC', start_at)) AS ls, timezone('America/Chicago', timezone('UTC', end_at)) AS le
  FROM raw),
src AS (
  SELECT lpad(CAST(seq AS VARCHAR), 9, '0') AS event_id, unnest(CASE WHEN seq % 3 = 0 THEN ['Zeta', 'Source B'] ELSE ['Source A'] END) AS source_name, source_url, seq % 5 <> 0 AS is_active FROM raw),
days AS (
  SELECT ev.*, CAST(unnest(generate_series(CAST(ls AS DATE), CAST(coalesce(le, ls) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM ev WHERE status = 'active' AND CAST(coalesce(le, ls) AS DATE) >= CAST(ls AS DATE)),
grouped AS (
  SELECT *, CASE WHEN bucket NOT IN ('allday', 'dropped') THEN hour(ls) END AS hour FROM (
    SELECT *, CASE
      WHEN all_day OR (CAST(ls AS DATE) < day AND coalesce(CAST(le AS DATE) > day, FALSE))
        OR (strftime(ls, '%H:%M') = '00:00' AND (le IS NULL OR end_at = start_at OR (strftime(le, '%H:%M') = '00:00' AND epoch(end_at) - epoch(start_at) >= 86400))) THEN 'allday'
      WHEN CAST(ls AS DATE) < day AND coalesce(CAST(le AS DATE) = day AND hour(le) < 3, FALSE) THEN 'dropped'
      WHEN CAST(ls AS DATE) < day THEN 'allday'
      WHEN hour(ls) >= 5 AND hour(ls) < 12 THEN 'morning' WHEN hour(ls) >= 12 AND hour(ls) < 17 THEN 'afternoon' WHEN hour(ls) >= 17 AND hour(ls) < 21 THEN 'evening' ELSE 'night' END AS bucket
    FROM days))
"""
