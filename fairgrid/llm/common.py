"""What several operators share: reading tables, folds, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small fixed-width table up to which it may be broadcast (about 100 MB at most).
BROADCAST_ROWS = 1_000_000

#: Labelled rows of each class, about, that a classifier is fitted on; their ids and labels are broadcast.
LABELLED_PER_CLASS = 400_000

#: A-Z to a-z on UTF-8 bytes; no other byte changes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Rows, and bytes, of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps what is in a Python worker and its JVM at a time small; texts may be long, and executors have many workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may be without it; it gets a temporary one."""
    if (named := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder; a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a table of the shared folder, compressed; smaller on disk than a checkpoint."""
    to = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark an already cut table for broadcast if it has ``limit`` rows at most (BROADCAST_ROWS, if none is given), else leave the join to shuffle."""
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


class Shared:
    """A broadcast of a value of bounded size, its class included: tasks call it for the value, and load it once each."""

    def __init__(self, df: DataFrame, value: Any):
        self.sent, self.held, self.name = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value)), [], uuid.uuid4().hex

    def __call__(self) -> Any:
        if not self.held:
            self.held.append(pickle.loads(self.sent.value))
        return self.held[0]

    def destroy(self) -> None:
        """To be called once everything that uses it is written or cut."""
        self.sent.destroy()


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def labelled(docs: DataFrame, labels: DataFrame, label: str, n: int, held: int, per_class: int = LABELLED_PER_CLASS) -> DataFrame:
    """(doc_id, text, y) of the labelled rows outside the held-out fold; repeated labels of an id count as their maximum.

    All of them, if a class has ``per_class`` at most, else about that many of
    it, by a hash of the id. They go to the texts, which never move.
    """
    y = cut(
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(fold(F.col("doc_id"), n) != held)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    total = dict(y.groupBy("y").count().collect())
    part = [F.lit(int((1 << 32) * min(1.0, per_class / max(1, total.get(k, 0))))) for k in (0, 1)]
    some = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.when(F.col("y") == 1, part[1]).otherwise(part[0]))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
