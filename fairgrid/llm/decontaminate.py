"""Benchmark decontamination on built-in functions only: SimHash of item-sized windows, Hamming blocks, exact similarity.

A document is contaminated by a benchmark item if one of its windows as long
as the item has a weighted (multiset) Jaccard similarity of ``threshold`` or
more with it, over shingles of five words. Words are runs of letters and
digits, without case; texts under five words are one shingle of them all.

1. Windows. Overlap of the threshold means sharing one of an item's rarest
   shingles, as many as make up more than (1 - threshold) of its weight; so
   documents are joined on these alone. Of the pairs that meet, windows are
   laid where a shared shingle stands at the place it has in the item, and at
   every shared shingle from which on as many are shared as the threshold asks
   for, so that parts in another order are found too.
2. Fingerprints. Windows and items get a 64-bit SimHash of their shingles.
3. Blocks. The 64 bits are cut into radius + 1 blocks; two fingerprints within
   the radius agree in one block at least, and only windows that share one with
   their item are looked at.
4. Verification. The exact similarity of what the blocks let through.

From the windows on all work is on arrays of one document and item, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, small

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 some 10 bits differ, with a deviation of 3 (12 of 64 for items of five shingles): more than this
#: in fewer than one of 100,000 windows. So wide a radius makes blocks of two or three bits, which part little.
RADIUS = 26


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(hashes: Column, n: int) -> Column:
    """Shingle hashes of an array of word hashes, in order; empty if there are fewer words."""
    one = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(0), F.size(hashes) - n), one)).otherwise(F.array().cast("array<bigint>"))


def _of_size(hashes: Column, n: Column) -> Column:
    """The same for a column ``n``."""
    out = _shingles(hashes, SHINGLE)
    for k in range(1, SHINGLE):
        out = F.when(n == k, _shingles(hashes, k)).otherwise(out)
    return out


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of an array of hashes, repeats included: a bit is set if over half of them have it."""
    bit = lambda h, b: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)) == 1
    ones = lambda b: F.size(F.filter(shingles, lambda h: bit(h, b)))
    one = F.lit(1).cast("long")
    add = lambda fp, b: F.when(ones(b) * 2 > F.size(shingles), fp.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(fp)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), add)


def blocks(fp: Column, radius: int) -> Column:
    """The bits of each of radius + 1 blocks, with the block's number above them."""
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(i).cast("long") * 2**32 for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def counted(shingles: Column) -> Column:
    """Hashes of an array's values and of how often each stood before, so that sets of these compare as multisets."""
    in_order = F.array_sort(shingles)
    again = F.transform(in_order, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(in_order, h)))
    once = F.transform(shingles, lambda h: F.xxhash64(h, F.lit(0).cast("long")))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), once).otherwise(again)


def item_table(items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(item, n, length, shingles, item_fp, item_blocks, wanted): n words a shingle; items equal in words share the smallest id."""
    heads = _hashed(items.select(F.col("item_id").alias("item"), "text")).where(F.size("hashes") > 0)
    heads = heads.groupBy("hashes").agg(F.min("item").alias("item")).where("item is not null")
    heads = heads.withColumn("length", F.size("hashes")).withColumn("n", F.least("length", F.lit(SHINGLE)))
    heads = heads.select("item", "n", "length", _of_size(F.col("hashes"), F.col("n")).alias("shingles"))
    heads = heads.withColumn("item_fp", simhash(F.col("shingles")))
    return heads.select("*", blocks(F.col("item_fp"), radius).alias("item_blocks"), counted(F.col("shingles")).alias("wanted"))


def _rare(table: DataFrame, threshold: float) -> DataFrame:
    """(item, n, h): of each item its rarest shingles (by items), up to a weight of more than (1 - threshold) of all."""
    shingles = table.select("item", "n", F.explode("shingles").alias("h")).groupBy("item", "n", "h").agg(F.count("*").alias("c"))
    spread = shingles.groupBy("h").agg(F.count("*").alias("df"))
    by = Window.partitionBy("item").orderBy("df", "h")
    before = F.coalesce(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("c").over(Window.partitionBy("item"))
    ranked = shingles.join(spread, "h").withColumn("before", before).withColumn("whole", whole)
    need = F.ceil(F.col("whole") * threshold - 1e-9)  # 100 * 0.55 is a bit more than 55
    return ranked.where(F.col("before") <= F.col("whole") - need).select("item", "n", "h")


def _starts(threshold: float) -> Column:
    """Where windows begin, of a row's document shingles ``hs`` and its item's ``shingles``, n and length."""
    wanted, hs, all_ = F.col("shingles"), F.col("hs"), F.size("shingles")
    place = F.col("shared")
    # a shared shingle at its place in the item, for the item's whole length
    placed = F.transform(place, lambda p: F.greatest(p + 1 - F.array_position(wanted, F.get(hs, p)).cast("int"), F.lit(0)))
    # and whatever the order of parts: a window loses nothing if it moves on to its first shared shingle, or the text's last window
    last = F.greatest(F.size(hs) - all_, F.lit(0))
    need = F.greatest(F.ceil((F.least(F.size(hs), all_) + all_) * (threshold / (1 + threshold)) - 1e-9).cast("int"), F.lit(1))
    enough = F.filter(place, lambda p, i: (p <= last) & (F.get(place, i + need - 1) < p + all_))
    at_end = F.when(F.get(place, F.size(place) - need) >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(placed, enough, at_end))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item, start, length, similarity): the best window of each contaminated document and item.

    Documents are told apart by doc_id and xxhash64(text), so repeated rows
    have one answer and null ids are allowed; start and length count words.
    Null, empty and wordless texts and items match nothing. Items with equal
    words go by their smallest id.
    """
    ids = ["doc_id", "text_hash"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    table = cut(item_table(items, radius))
    sizes = sorted(r.n for r in table.select("n").distinct().collect())
    if not sizes:
        schema = "doc_id long, text_hash long, item long, start int, length int, similarity double"
        return docs.sparkSession.createDataFrame([], schema)

    tagged = lambda n: lambda h: F.struct(F.lit(n).alias("n"), h.alias("h"))
    parts = F.flatten(F.array(*[F.transform(_shingles(F.col("hashes"), n), tagged(n)) for n in sizes]))
    posts = _hashed(docs).select(*ids, "hashes").select(*ids, F.inline(parts))
    pairs = cut(posts.join(small(cut(_rare(table, threshold))), ["n", "h"]).select(*ids, "item").distinct())
    some = small(cut(pairs.select(*ids).distinct()))
    on = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    hit = _hashed(docs.join(some, on(docs, some), "left_semi")).select(*ids, "hashes")
    asked = pairs.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    rows = hit.join(small(asked), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).join(small(table), "item")
    rows = rows.withColumn("hs", _of_size(F.col("hashes"), F.col("n")))
    rows = rows.withColumn("shared", F.array_compact(F.transform("hs", lambda h, p: F.when(F.array_contains("shingles", h), p))))
    rows = rows.select(*ids, "item", "length", "shingles", "item_fp", "item_blocks", "wanted", "hs", F.explode(_starts(threshold)).alias("start"))
    rows = rows.withColumn("window", F.slice("hs", F.col("start") + 1, F.size("shingles"))).drop("hs")
    fits = lambda fp: F.arrays_overlap(blocks(fp, radius), "item_blocks") & (F.bit_count(fp.bitwiseXOR(F.col("item_fp"))) <= radius)
    near = rows.where(F.exists(F.array(simhash(F.col("window"))), fits))  # of an array of one, so that the fingerprint is computed once
    both = F.size(F.array_intersect(counted(F.col("window")), "wanted"))
    near = near.withColumn("common", both).withColumn("similarity", F.col("common") / (F.size("window") + F.size("shingles") - F.col("common")))
    best = near.where(F.col("similarity") >= threshold).groupBy(*ids, "item").agg(F.max(F.struct("similarity", -F.col("start"), "length")).alias("b"))
    return best.select(*ids, "item", (-F.col("b.col2")).alias("start"), "b.length", "b.similarity")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without contaminated documents."""
    bad = cut(contaminated(docs, items, threshold, radius).select("doc_id", "text_hash").distinct())
    h = fresh(docs, "text_hash")
    named = docs.withColumn(h, F.xxhash64("text"))
    bad = bad.withColumnsRenamed({"doc_id": "bad_id", "text_hash": "bad_hash"})
    return named.join(small(bad), named["doc_id"].eqNullSafe(bad["bad_id"]) & (named[h] == bad["bad_hash"]), "left_anti").drop(h)


def report(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (ascending, comma-joined), similarity (the largest; null if none)."""
    found = cut(contaminated(docs, items, threshold, radius))
    found = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item")), ",").alias("item_ids"), F.max("similarity").alias("similarity"))
    found = cut(found).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    out = rows.join(small(found), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return out.select("doc_id", F.col("t").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), "similarity")
