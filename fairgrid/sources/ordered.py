"""The order of rows in a set of files.

Spark's readers tell each row's file and where its split begins, and give a
split's rows in the order of the file; so (file, split, place in the split) is
the order of the whole set, whichever task reads what and wherever the files
are. A reader in Python would have to open files itself, which stores that only
Spark reaches don't allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import small
from ..operators.numbering import dense

_IN_SPLIT = (1 << 33) - 1


def in_order(files: DataFrame) -> DataFrame:
    """``files``, just read, with seq: ascending by file name, split and place in the split; gaps between splits.

    Splits are numbered over the whole set, a row each, and sent to the rows if
    they are few enough, so that rows stay where they are read.
    """
    rows = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_SPLIT)).alias("_place"))
    splits = dense(rows.select("_file", "_block").distinct(), ["_file", "_block"], "_split")
    splits = small(splits, F.length("_file") + 100)
    return rows.join(splits, ["_file", "_block"]).withColumn("seq", F.shiftleft(F.col("_split"), 33) + F.col("_place")).drop("_file", "_block", "_split", "_place")
