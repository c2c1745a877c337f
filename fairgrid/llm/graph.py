"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) long edges to (node, root): root is the smallest node of the component.

    Every node of an edge gets one row; self edges and repeated edges are
    allowed; an empty table gives an empty one. Each round is two aggregations
    and two joins on the node, kept in the checkpoint folder; joins on a hub
    are inner joins that adaptive execution can split.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(now)
    for _ in range(most_rounds if seen[0] else 0):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        if (mark := _mark(now)) == seen:
            break
        seen = mark
    else:
        if seen[0]:
            raise RuntimeError("components didn't converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
