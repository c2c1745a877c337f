"""Computing a table once, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table, about, up to which it is sent to all executors.
BROADCAST_BYTES = 32 << 20


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may be without it, and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    return named.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder named in spark.checkpoint.dir; survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_root(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, size: Column) -> DataFrame:
    """Mark an already cut table for broadcast if its rows' ``size``, in bytes, adds up to BROADCAST_BYTES at most; else leave the join to shuffle."""
    total = df.agg(F.sum(size)).first()[0]
    return F.broadcast(df) if (total or 0) <= BROADCAST_BYTES else df
