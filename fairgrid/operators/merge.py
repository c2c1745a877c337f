"""Merging one source's delivery into the event and source snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import dedupe

FILLED = ("description", "end_at", "venue_name", "venue_address", "image_url")


@dataclass
class Merged:
    events: DataFrame
    sources: DataFrame
    actions: DataFrame  # (event_id, inserted, updated) of every event that the delivery touches
    stale: DataFrame  # (event_id, source_name) of listings that this run puts out


def attach(raws: DataFrame, events: DataFrame, threshold: float | None = dedupe.THRESHOLD) -> DataFrame:
    """Collapsed raws with event_id and founds; threshold None: by hash alone."""
    found = dedupe.exact_matches(raws, events)
    hits = found.where("event_id is not null").withColumn("founds", F.lit(False))
    misses = found.where("event_id is null").drop("event_id")
    if threshold is None:
        return hits.unionByName(misses.withColumns({"event_id": F.col("canonical_hash"), "founds": F.lit(True)}))
    return hits.unionByName(misses.join(dedupe.link_misses(misses, events, threshold), "canonical_hash"))


def _order(raws: DataFrame) -> Column:
    """What raws are ordered by: seq, and the place in its document if that is told."""
    return F.struct("seq", "place") if "place" in raws.columns else F.struct("seq")


def _per_event(attached: DataFrame) -> DataFrame:
    """What an event's raws bring, in feed order: fills, the first timed one, ends before and after it, categories.

    All of it are aggregates that are merged from parts; only the distinct
    categories of an event are listed.
    """
    later = attached.where("not founds").withColumn("at", _order(attached))
    fills = [F.expr(f"min_by({f}, at) filter (where {f} is not null)").alias(f"raw_{f}") for f in FILLED]
    timed = F.expr("min_by(struct(at, start_at, end_at), at) filter (where not all_day)").alias("timed")
    per = later.groupBy("event_id").agg(*fills, timed, F.count("*").alias("n_raws"))
    since = per.where("timed is not null and timed.end_at is null").select("event_id", F.col("timed.at").alias("since"))
    after = later.where("end_at is not null").join(since, "event_id").where("at > since").groupBy("event_id").agg(F.min_by("end_at", "at").alias("end_after"))
    each = later.select("event_id", "at", F.posexplode("categories").alias("pos", "category")).groupBy("event_id", "category").agg(F.min(F.struct("at", "pos")).alias("first"))
    brought = F.transform(F.array_sort(F.collect_list(F.struct("first", "category"))), lambda x: x["category"])
    return per.join(after, "event_id", "left").join(each.groupBy("event_id").agg(brought.alias("brought")), "event_id", "left")


def merge_fields(events: DataFrame, attached: DataFrame) -> DataFrame:
    """Events with what their later raws add; ``changed`` where that is anything.

    Null fields are filled by the first raw that has them, categories appended
    in order, removed events revived. An all-day event takes start and end of
    its first timed raw, even no end; raws after that may still fill the end.
    """
    e = events.join(_per_event(attached), "event_id", "left")
    e = e.withColumn("timed", F.when(F.col("all_day"), F.col("timed")))
    upgraded = F.col("timed").isNotNull()
    end = F.when(upgraded, F.coalesce("timed.end_at", "end_after")).otherwise(F.coalesce("end_at", "raw_end_at"))
    empty = F.array().cast("array<string>")
    has = F.coalesce("categories", empty)
    new = F.filter(F.coalesce("brought", empty), lambda c: ~F.coalesce(F.array_contains(has, c), F.lit(False)))
    revived = (F.col("status") == "removed") & (F.coalesce("n_raws", F.lit(0)) > 0)
    filled = [F.col(f).isNull() & F.col(f"raw_{f}").isNotNull() for f in FILLED]
    changed: Column = revived | upgraded | (F.size(new) > 0)
    for f in filled:
        changed = changed | f
    values = {f: F.coalesce(f, f"raw_{f}") for f in FILLED if f != "end_at"}
    e = e.withColumns(
        values
        | {
            "changed": changed,
            "new_end": end,
            "new_start": F.when(upgraded, F.col("timed.start_at")).otherwise(F.col("start_at")),
            "new_categories": F.when(F.size(new) > 0, F.concat(has, new)).otherwise(F.col("categories")),
            "new_status": F.when(revived, "active").otherwise(F.col("status")),
            "new_all_day": F.col("all_day") & ~upgraded,
        }
    )
    for c, new in (("end_at", "new_end"), ("start_at", "new_start"), ("categories", "new_categories"), ("status", "new_status"), ("all_day", "new_all_day")):
        e = e.withColumn(c, F.col(new))
    return e.select(*events.columns, "changed")


def new_events(attached: DataFrame, run_start: Column) -> DataFrame:
    none = F.lit(None)
    return attached.where("founds").select(
        "event_id", "title", "description", "start_at", "end_at", "venue_name", "venue_address",
        none.cast("double").alias("latitude"), none.cast("double").alias("longitude"), "categories", "image_url", "all_day",
        "canonical_hash", F.lit("active").alias("status"), run_start.alias("created_at"), run_start.alias("updated_at"),
    )


def upsert_sources(sources: DataFrame, attached: DataFrame, source_name: str, run_start: Column) -> DataFrame:
    """One row per (event, source): the first raw's address wins, and the run's time; others stay as they are."""
    seen = attached.groupBy("event_id").agg(F.min_by("source_url", _order(attached)).alias("new_url")).withColumn("source_name", F.lit(source_name))
    both = sources.join(seen, ["event_id", "source_name"], "full_outer")
    hit = F.col("new_url").isNotNull()
    return both.select(
        "event_id", "source_name", F.coalesce("new_url", "source_url").alias("source_url"),
        F.when(hit, run_start).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        (hit | F.coalesce("is_active", F.lit(False))).alias("is_active"),
        F.coalesce("created_at", run_start).alias("created_at"),
    )


def stale(sources: DataFrame, source_name: str, run_start: Column) -> Column:
    return (F.col("source_name") == source_name) & (F.col("last_seen_at") < run_start) & F.col("is_active")


def retire(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Active events without an active source are removed."""
    live = sources.where("is_active").select("event_id").distinct().withColumn("live", F.lit(True))
    gone = (F.col("status") == "active") & F.col("live").isNull()
    return events.join(live, "event_id", "left").withColumn("status", F.when(gone, "removed").otherwise(F.col("status"))).drop("live")


def ingest(raws: DataFrame, events: DataFrame, sources: DataFrame, source_name: str, run_start: str, threshold: float | None = dedupe.THRESHOLD) -> Merged:
    """One delivery of one source. An empty one puts out all of the source's listings; a failed source isn't ingested at all."""
    now = F.lit(run_start).cast("timestamp")
    attached = cut(attach(cut(dedupe.collapse(raws)), events, threshold))  # everything below comes from it
    founded = new_events(attached, now)
    merged = cut(merge_fields(events.unionByName(founded), attached))
    changed = merged.where("changed").select("event_id", F.lit(True).alias("updated"))
    actions = attached.groupBy("event_id").agg(F.bool_or("founds").alias("inserted")).join(changed, "event_id", "left")
    actions = actions.withColumn("updated", F.coalesce("updated", F.lit(False)))
    merged = merged.withColumn("updated_at", F.when(F.col("changed"), now).otherwise(F.col("updated_at"))).drop("changed")
    after = upsert_sources(sources, attached, source_name, now)
    out = after.where(stale(after, source_name, now)).select("event_id", "source_name")
    after = after.withColumn("is_active", F.col("is_active") & ~stale(after, source_name, now))
    return Merged(retire(merged, after), after, actions, out)


def run_stats(m: Merged) -> DataFrame:
    """One row: inserted, updated (events that changed), deactivated (listings)."""
    one = m.actions.agg(F.count_if(F.col("inserted")).alias("inserted"), F.count_if(F.col("updated")).alias("updated"))
    return one.crossJoin(m.stale.agg(F.count("*").alias("deactivated")))
