"""Event tables as versioned Parquet snapshots, and nested JSON for serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import EVENT_SOURCES, EVENTS, VENUE_GEOCODES, struct

TABLES = {"events": EVENTS, "event_sources": EVENT_SOURCES, "venue_geocodes": VENUE_GEOCODES}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], struct(TABLES[name]))


def read(spark: SparkSession, root: str, version: str | None, name: str) -> DataFrame:
    """A table of a version with its declared schema; empty for no version."""
    if version is None:
        return empty(spark, name)
    return spark.read.schema(struct(TABLES[name])).parquet(f"{root}/{version}/{name}")


def write(df: DataFrame, root: str, version: str, name: str, mode: str = "errorifexists") -> None:
    """A new version; earlier ones stay, so a failed run leaves them whole."""
    columns = [f.name for f in struct(TABLES[name]).fields]
    df.select(*columns).write.mode(mode).parquet(f"{root}/{version}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """The same table from a database, by Spark's JDBC reader."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def nested(days: DataFrame) -> DataFrame:
    """What is served of a day: event columns with categories and sources as arrays."""
    return days.select("day", "event_id", "title", "description", "start_at", "end_at", "venue_name", "venue_address", "latitude", "longitude", "categories", "image_url", "all_day", "status", "sources")


def write_days(days: DataFrame, path: str) -> None:
    """JSON lines per day, in start order; a day's rows are spread over tasks by Spark, not gathered in one array."""
    nested(days).repartitionByRange("day", "start_at", "event_id").sortWithinPartitions("day", "start_at", "event_id").write.partitionBy("day").json(path)


def write_ical(events: DataFrame, path: str, content: Column, filename: Column) -> None:
    """One Parquet row (filename, content) per event; write.text of the content gives plain files."""
    events.select(filename.alias("filename"), content.alias("content")).write.parquet(path)


def read_days(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).withColumn("day", F.col("day").cast("date"))
