"""Substring search over many names for many terms by an index of short strings, checked exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest strings of the index; shorter ones serve terms that are shorter.
GRAM = 3


def _grams(c: Column, n: int) -> Column:
    """Distinct strings of ``n`` characters in a text."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def index(names: DataFrame, column: str) -> DataFrame:
    """(gram, name): the distinct names of a column under each string of one to GRAM characters in them, lower-cased; nulls aren't there."""
    own = names.select(F.col(column).alias("name")).where("name is not null").distinct()
    low = F.lower("name")
    return own.select("name", F.explode(F.concat(*[_grams(low, n) for n in range(1, GRAM + 1)])).alias("gram")).select("gram", "name")


def search(indexed: DataFrame, names: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """(term, name) for each distinct term and name that holds it, without regard to case.

    A term looks up the one of its strings that fewest names have, and only
    these names are compared; a term with a string that no name has finds
    nothing. An empty term finds all names, a null one none.
    """
    asked = terms.select("term").where("term is not null").distinct().withColumn("low", F.lower("term"))
    counts = indexed.groupBy("gram").agg(F.count("*").alias("n"))
    parts = F.when(F.length("low") >= GRAM, _grams(F.col("low"), GRAM)).when(F.length("low") == 2, F.array("low")).otherwise(F.array("low"))
    each = asked.where("low != ''").select("term", "low", F.explode(parts).alias("gram")).join(counts, "gram", "left")
    rare = each.groupBy("term", "low").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all")
    found = rare.join(indexed, "gram").where(F.contains(F.lower("name"), F.col("low"))).select("term", "name")
    every = names.select(F.col(column).alias("name")).where("name is not null").distinct().withColumn("term", F.lit(""))
    return found.unionByName(every.join(asked.where("low = ''").select("term"), "term").select("term", "name"))
