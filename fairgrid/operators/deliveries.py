"""Many deliveries at once: what ingesting them one after another by hash leaves, in one pass.

An event and a listing (an event at a source) depend only on the deliveries
that have them and on when their sources deliver, so everything is grouped by
event: fields are folded over the deliveries in their order, and a listing
lives from a delivery that has it until its source's next later one that
doesn't. An event that nothing keeps alive is removed, and revived by the next
delivery that has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import dedupe, merge

#: Number of a delivery after all others: what lives until then lives on.
NEVER = 2**31 - 1


def _numbered(spark: SparkSession, deliveries: list[tuple[str | None, str]]) -> DataFrame:
    """(d, source_name, run_start) of the deliveries in their order; a row for each, however many rows they have."""
    rows = [(d, source, run) for d, (source, run) in enumerate(deliveries)]
    return spark.createDataFrame(rows, "d int, source_name string, run string").select("d", "source_name", F.col("run").cast("timestamp").alias("run_start"))


def _attached(raws: DataFrame, events: DataFrame) -> DataFrame:
    """Raws, one for each delivery and hash, with their event; the first one of a hash without an event founds it. seq is the delivery."""
    keyed = dedupe.with_hash(raws).withColumn("canonical_hash", F.concat_ws("|", F.col("d").cast("string"), "canonical_hash"))
    one = dedupe.collapse(keyed).withColumn("canonical_hash", F.substring_index("canonical_hash", "|", -1)).drop("seq", "place")
    found = dedupe.exact_matches(one, events)
    first = F.row_number().over(Window.partitionBy("canonical_hash").orderBy("d")) == 1
    found = found.withColumn("founds", F.col("event_id").isNull() & first)
    return found.withColumns({"event_id": F.coalesce("event_id", "canonical_hash"), "seq": F.col("d").cast("long")})


def _lives(attached: DataFrame, sources: DataFrame, numbered: DataFrame) -> DataFrame:
    """(event_id, source_name, since, out) of listings: live after delivery ``since`` (-1: before all) and until ``out``."""
    times = F.broadcast(numbered.groupBy("source_name").agg(F.collect_list(F.struct("d", "run_start")).alias("runs")))  # a row for each delivery
    out = lambda since, seen: F.coalesce(F.array_min(F.transform(F.filter("runs", lambda r: (r["d"] > since) & (r["run_start"] > seen)), lambda r: r["d"])), F.lit(NEVER))
    runs = F.broadcast(numbered.select("d", "run_start"))
    seen = attached.select("event_id", "source_name", "d").join(runs, "d").select("event_id", "source_name", F.col("d").alias("since"), F.col("run_start").alias("seen"))
    before = sources.where("is_active").select("event_id", "source_name", F.lit(-1).alias("since"), F.col("last_seen_at").alias("seen"))
    both = seen.unionByName(before).join(times, "source_name", "left")
    return both.select("event_id", "source_name", "since", out(F.col("since"), F.col("seen")).alias("out"))


def _last_change(base: DataFrame, attached: DataFrame, revived: DataFrame) -> DataFrame:
    """(event_id, d) of the last delivery that changes an event; no row for events that none changes."""
    later = attached.where("not founds")
    texts = [f for f in merge.FILLED if f != "end_at"]
    firsts = [F.min(F.when(F.col(f).isNotNull(), F.col("d"))).alias(f"d_{f}") for f in merge.FILLED]
    per = later.groupBy("event_id").agg(*firsts, F.min(F.when(~F.col("all_day"), F.col("d"))).alias("d_timed"), F.min_by("end_at", F.when(~F.col("all_day"), F.col("d"))).alias("timed_end"))
    since = per.where("d_timed is not null and timed_end is null").select("event_id", "d_timed")
    after = later.where("end_at is not null").join(since, "event_id").where("d > d_timed").groupBy("event_id").agg(F.min("d").alias("d_after"))
    each = later.select("event_id", "d", F.explode("categories").alias("category")).groupBy("event_id", "category").agg(F.min("d").alias("d"))
    each = each.groupBy("event_id").agg(F.collect_list(F.struct("category", "d")).alias("brought"))  # distinct categories
    e = base.join(per, "event_id").join(after, "event_id", "left").join(each, "event_id", "left").join(revived, "event_id", "left")
    upgraded = F.col("all_day") & F.col("d_timed").isNotNull()
    has = F.coalesce("categories", F.array().cast("array<string>"))
    new = F.filter("brought", lambda c: ~F.coalesce(F.array_contains(has, c["category"]), F.lit(False)))
    none = F.lit(-1)
    changes = [F.coalesce(F.when(F.col(f).isNull(), F.col(f"d_{f}")), none) for f in texts]
    end = F.when(upgraded, F.greatest("d_timed", F.coalesce("d_after", none))).when(F.col("end_at").isNull(), F.col("d_end_at"))
    changes += [F.coalesce(end, none), F.coalesce(F.array_max(F.transform(new, lambda c: c["d"])), none), F.coalesce("d_revived", none)]
    return e.select("event_id", F.greatest(*changes).alias("d")).where("d >= 0")


def ingest_many(raws: DataFrame, events: DataFrame, sources: DataFrame, deliveries: list[tuple[str | None, str]]) -> merge.Merged:
    """Ingests deliveries in their order, linking by hash alone: the same tables as merge.ingest() once for each.

    raws: raw events with ``d``, the place of their delivery in ``deliveries``,
    a list of (source_name, run_start); deliveries without rows count. Actions
    are those of all deliveries together, stale listings those that end put out.
    """
    spark = events.sparkSession
    numbered = _numbered(spark, deliveries)
    runs = F.broadcast(numbered.select("d", "run_start"))
    names = F.broadcast(numbered.select("d", "source_name"))
    attached = cut(_attached(raws.drop("source_name").join(names, "d"), events))
    founded = merge.new_events(attached.join(runs, "d"), F.col("run_start"))
    base = events.unionByName(founded)
    lives = cut(_lives(attached, sources, numbered))
    # an event is revived by a delivery that finds nothing alive just before it
    seen = attached.select("event_id", F.col("d").alias("since"), F.lit(True).alias("sighting")).distinct()
    spans = lives.groupBy("event_id", "since").agg(F.max("out").alias("out")).join(seen, ["event_id", "since"], "left")
    was = events.select("event_id", F.col("status").alias("was"))
    earlier = F.max("out").over(Window.partitionBy("event_id").orderBy("since").rowsBetween(Window.unboundedPreceding, -1))
    known = spans.withColumn("earlier", earlier).where("sighting").join(was, "event_id", "left")
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("since")) == 1
    known = known.withColumn("first", first)
    # before its first sighting an event of before may be removed already, or have nothing that keeps it
    gone = F.when(F.col("first") & F.col("was").isNull(), F.lit(False)).when(F.col("first"), (F.col("was") == "removed") | (F.coalesce("earlier", F.lit(0)) < F.col("since"))).otherwise(F.col("earlier") < F.col("since"))
    revived = known.where(gone).groupBy("event_id").agg(F.max("since").alias("d_revived"))
    last = _last_change(base, attached, revived).join(runs, "d").select("event_id", F.col("run_start").alias("changed_at"))
    merged = merge.merge_fields(base, attached).drop("changed").join(last, "event_id", "left")
    merged = merged.withColumn("updated_at", F.coalesce("changed_at", "updated_at"))
    alive = lives.groupBy("event_id").agg(F.max("out").alias("out")).where(F.col("out") == NEVER).select("event_id", F.lit(True).alias("alive"))
    touched = attached.select("event_id").distinct().withColumn("touched", F.lit(True))
    merged = merged.join(alive, "event_id", "left").join(touched, "event_id", "left")
    active = (F.col("status") == "active") | F.col("touched").isNotNull()
    status = F.when(active & F.col("alive").isNull(), "removed").when(active, "active").otherwise(F.col("status")) if deliveries else F.col("status")
    actions = attached.groupBy("event_id").agg(F.bool_or("founds").alias("inserted")).join(last.select("event_id", F.lit(True).alias("updated")), "event_id", "left").withColumn("updated", F.coalesce("updated", F.lit(False)))
    seen = attached.join(runs, "d").groupBy("event_id", "source_name").agg(F.max_by("source_url", "d").alias("new_url"), F.max_by("run_start", "d").alias("new_seen"), F.min_by("run_start", "d").alias("new_created"))
    ends = lives.groupBy("event_id", "source_name").agg(F.max_by("out", "since").alias("out"))
    both = sources.join(seen, ["event_id", "source_name"], "full_outer").join(ends, ["event_id", "source_name"], "left")
    live = F.coalesce(F.col("out") == NEVER, F.lit(False))
    stale = both.where(((F.col("new_seen").isNotNull()) | F.col("is_active")) & ~live).select("event_id", "source_name")
    after = both.select("event_id", "source_name", F.coalesce("new_url", "source_url").alias("source_url"), F.coalesce("new_seen", "last_seen_at").alias("last_seen_at"), live.alias("is_active"), F.coalesce("created_at", "new_created").alias("created_at"))
    return merge.Merged(merged.withColumn("status", status).select(*events.columns), after, actions, stale)
