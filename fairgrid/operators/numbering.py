"""Places in an order over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

_IN_PARTITION = (1 << 33) - 1


def dense(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``, 0, 1, 2, ... in the order of ``order`` (columns that tell all rows apart).

    Range partitions are sorted and counted, and each partition's first place
    is the sum of the counts before it: a row for each partition meets in one
    task, never the table.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("_part", before.alias("_first"))
    return dealt.join(first, "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")
