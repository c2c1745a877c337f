"""Periodic ingest of snapshot deliveries from a landing folder."""

from __future__ import annotations

from zlib import crc32

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.schemas import RAW
from ..operators import dedupe, deliveries, merge
from ..sources import store

DELIVERY = f"delivery string, {RAW}"


#: One row per published version, appended once both of its tables are there.
PUBLISHED = "version string, batch long, place int"


def published(spark: SparkSession, root: str) -> DataFrame:
    """(version, batch, place) of the versions that are whole."""
    try:
        return spark.read.schema(PUBLISHED).parquet(f"{root}/_published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PUBLISHED)


def newest(spark: SparkSession, root: str) -> str | None:
    """The version that was published last; None for none."""
    return published(spark, root).agg(F.max_by("version", F.struct("batch", "place"))).first()[0]


def ingest_once(spark: SparkSession, root: str, version: str | None, raws: DataFrame, source_name: str, run_start: str, name: str, threshold: float | None = dedupe.THRESHOLD, batch: int = 0, place: int = 0) -> str:
    """Merges one delivery into a version and writes the version ``name``, which counts only once both of its tables are there.

    Tables that an earlier try left behind without publishing them are written anew.
    """
    events, sources = (store.read(spark, root, version, t) for t in ("events", "event_sources"))
    return _publish(spark, root, merge.ingest(raws, events, sources, source_name, run_start, threshold), name, batch, place)


def ingest_batch(spark: SparkSession, root: str, version: str | None, raws: DataFrame, given: list[tuple[str | None, str]], name: str, batch: int = 0) -> str:
    """Merges many deliveries (raws with ``d``, the place in ``given``) by hash in one pass, as one version."""
    events, sources = (store.read(spark, root, version, t) for t in ("events", "event_sources"))
    return _publish(spark, root, deliveries.ingest_many(raws, events, sources, given), name, batch, 0)


def _publish(spark: SparkSession, root: str, done: merge.Merged, name: str, batch: int, place: int) -> str:
    store.write(done.events, root, name, "events", mode="overwrite")
    store.write(done.sources, root, name, "event_sources", mode="overwrite")
    spark.createDataFrame([(name, batch, place)], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{root}/_published")
    return name


def stream_deliveries(spark: SparkSession, landing: str, root: str, checkpoint: str, run_start_of, threshold: float | None = dedupe.THRESHOLD, files: int | None = 1, at_once: bool = False) -> StreamingQuery:
    """Ingests every file of ``landing`` once (availableNow), ``files`` at a time (None: all), delivery by delivery.

    What comes at once holds whole deliveries: raw events with a ``delivery``
    column, taken in order of delivery and source, each with a version of its
    own; ``at_once``, for threshold None, takes all of them in one pass and
    makes one version. ``run_start_of`` maps a batch number to the run's time; deliveries may
    share one. Versions are the state, the newest one is where a start goes on;
    the stream's own checkpoint only remembers files. Of a batch that is run
    again after a failure, deliveries that were published are passed over. One
    stream at a time writes to a store.
    """
    if at_once and threshold is not None:
        raise ValueError("deliveries are taken at once by hash alone: threshold must be None")
    stream_id = f"{crc32(checkpoint.rstrip('/').encode()):08x}"
    since = published(spark, root).where(~F.startswith("version", F.lit(f"{stream_id}-"))).agg(F.max("batch")).first()[0]
    offset = 0 if since is None else since + 1  # another stream's versions are older

    def one(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        there = {r.version for r in published(spark, root).where(F.col("batch") == offset + batch_id).collect()}
        keys = held.select("delivery", "source_name").distinct().orderBy("delivery", "source_name").collect()
        if at_once:
            name = f"{stream_id}-{batch_id:08d}-{0:06d}"
            if name not in there and keys:
                order = spark.createDataFrame([(d, r.delivery, r.source_name) for d, r in enumerate(keys)], "d int, of string, at string")
                mine = held.join(F.broadcast(order), held.delivery.eqNullSafe(order["of"]) & held.source_name.eqNullSafe(order["at"])).drop("delivery", "of", "at")
                ingest_batch(spark, root, newest(spark, root), mine, [(r.source_name, run_start_of(batch_id)) for r in keys], name, offset + batch_id)
            keys = []
        for place, row in enumerate(keys):
            name = f"{stream_id}-{batch_id:08d}-{place:06d}"
            if name not in there:
                mine = held.where(held.delivery.eqNullSafe(row.delivery) & held.source_name.eqNullSafe(row.source_name)).drop("delivery")
                ingest_once(spark, root, newest(spark, root), mine, row.source_name, run_start_of(batch_id), name, threshold, offset + batch_id, place)
        held.unpersist()

    reader = spark.readStream.schema(DELIVERY)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).json(landing)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
