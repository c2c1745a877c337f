"""Which raw event is which real one: collapse by hash, exact match, fuzzy title match within time and venue blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.lineage import cut

THRESHOLD = 0.65


def with_hash(raws: DataFrame) -> DataFrame:
    return raws.withColumn("canonical_hash", text.canonical_hash(F.col("title"), F.col("start_local_date"), F.col("venue_name")))


def collapse(raws: DataFrame) -> DataFrame:
    """One row per hash: the first by seq (and place in its document, if told), with the categories of all in their order, each once."""
    raws = raws if "canonical_hash" in raws.columns else with_hash(raws)
    others = [c for c in raws.columns if c not in ("canonical_hash", "categories")]
    order = F.struct("seq", *(["place"] if "place" in raws.columns else []))
    # a category comes once per hash before any list is made, however many rows have the hash
    each = raws.select("canonical_hash", order.alias("at"), F.struct(*others).alias("row"), F.posexplode_outer("categories").alias("pos", "category"))
    each = each.groupBy("canonical_hash", "category").agg(F.min(F.when(F.col("pos").isNotNull(), F.struct("at", "pos"))).alias("named"), F.min("at").alias("at"), F.min_by("row", "at").alias("row"))
    listed = F.array_sort(F.collect_list(F.when(F.col("named").isNotNull(), F.struct("named", "category"))))
    united = F.transform(listed, lambda x: x["category"])
    got = each.groupBy("canonical_hash").agg(F.min_by("row", "at").alias("first"), united.alias("categories"))
    return got.select("canonical_hash", "first.*", "categories")


def exact_matches(raws: DataFrame, events: DataFrame) -> DataFrame:
    """Adds event_id of the event with the raw's hash, whatever its status; null for a miss."""
    return raws.join(events.select("canonical_hash", "event_id"), "canonical_hash", "left")


def venue_key(venue: Column) -> Column:
    return text.key_text(F.coalesce(venue, F.lit("")))


def block_date(all_day: Column, local_date: Column, start: Column) -> Column:
    """The date on which a raw meets candidates: its own for all-day ones, else that of the instant in UTC."""
    return F.when(all_day, local_date).otherwise(F.to_date(start))


def fuzzy_candidates(misses: DataFrame, events: DataFrame) -> DataFrame:
    """(hash, event_id, raw_title, event_title) of every pair with the same time anchor.

    With a venue: equal venue and equal start, or equal date for all-day raws.
    Without: equal start; all-day raws have none. Removed events are no
    candidates. Pairs whose lengths can't reach the threshold are left out
    before any ratio is computed.
    """
    raws = misses.select("canonical_hash", text.key_text(F.col("title")).alias("raw_title"), "start_at", "all_day", venue_key(F.col("venue_name")).alias("venue"), block_date(F.col("all_day"), F.col("start_local_date"), F.col("start_at")).alias("day"))
    there = events.where("status != 'removed'").select("event_id", text.key_text(F.col("title")).alias("event_title"), F.col("start_at").alias("event_start"), text.key_text(F.col("venue_name")).alias("venue"), F.to_date("start_at").alias("day"))
    near = raws.where("venue != ''").join(there.where("venue != ''"), ["day", "venue"]).where(F.col("all_day") | (F.col("start_at") == F.col("event_start")))
    open_ = raws.where("venue = '' and not all_day").drop("venue", "day").join(there.drop("venue", "day"), F.col("start_at") == F.col("event_start"))
    cols = ["canonical_hash", "event_id", "raw_title", "event_title"]
    return near.select(cols).union(open_.select(cols)).where(can_reach(F.col("raw_title"), F.col("event_title")))


def can_reach(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """The ratio is 2 * matches / lengths, and there are no more matches than the shorter length."""
    return F.least(F.length(a), F.length(b)) * 2.0 >= (F.length(a) + F.length(b)) * F.lit(threshold)


def letters(title: Column) -> Column:
    """A title's letters, each with its number among equal ones: as a set, what a multiset of letters is."""
    sorted_ = F.array_sort(F.regexp_extract_all(title, F.lit("(?s)(.)"), F.lit(1)))
    return F.transform(sorted_, lambda c, i: F.concat(c, (i - F.array_position(sorted_, c)).cast("string")))


def can_match(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Whether the letters in common, in whatever order, suffice for the threshold; a and b are letters()."""
    return F.size(F.array_intersect(a, b)) * 2.0 >= (F.size(a) + F.size(b)) * F.lit(threshold)


@F.pandas_udf(T.DoubleType())
def title_ratio(raw, event):
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    from difflib import SequenceMatcher

    import pandas as pd

    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(raw, event, strict=True)], dtype="float64")


def best_matches(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(canonical_hash, event_id, ratio): the best candidate of each raw at the threshold or over, ties to the smallest event_id."""
    pairs = pairs.where(can_match(letters(F.col("raw_title")), letters(F.col("event_title")), threshold))
    scored = pairs.withColumn("ratio", title_ratio("raw_title", "event_title")).where(F.col("ratio") >= threshold)
    rank = F.row_number().over(Window.partitionBy("canonical_hash").orderBy(F.desc("ratio"), "event_id"))
    return scored.withColumn("k", rank).where("k = 1").select("canonical_hash", "event_id", "ratio")


#: Candidates with no time of their founding are older than any raw.
_BEFORE = -(2**62)


def _scored(classes: DataFrame, there: DataFrame, threshold: float) -> DataFrame:
    """(id, first, known_key, known_seq, settled, ratio): the pairs of a class and a candidate of its block that reach the threshold."""
    c = classes.select("block", F.col("key").alias("id"), F.col("title").alias("raw_title"), F.col("start_us").alias("raw_start"), "all_day", F.col("seq").alias("first"), "last")
    there = there.select("block", F.col("key").alias("known_key"), F.col("title").alias("event_title"), "start_us", F.col("seq").alias("known_seq"), "settled")
    c, there = c.withColumn("raw_letters", letters(F.col("raw_title"))), there.withColumn("event_letters", letters(F.col("event_title")))
    pairs = c.join(there, "block").where((F.col("all_day") | (F.col("raw_start") == F.col("start_us"))) & (F.col("known_seq") < F.col("last")) & (F.col("id") != F.col("known_key")))
    pairs = pairs.where(can_reach(F.col("raw_title"), F.col("event_title"), threshold)).where(can_match(F.col("raw_letters"), F.col("event_letters"), threshold))
    return pairs.withColumn("ratio", title_ratio("raw_title", "event_title")).where(F.col("ratio") >= threshold).select("id", "first", "known_key", "known_seq", "settled", "ratio")


def first_come(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes that one pass in order would keep: those without a kept node before them.

    nodes: (id). edges: (id, before) for each node and neighbour that comes
    before it. In a round the nodes without an open neighbour before them stay,
    and all that have an edge to one of these go, with their edges. Rounds end
    with the edges; each settles at least the first node that has one.
    """
    edges, gone = cut(edges.select("id", "before").distinct()), None
    while not edges.isEmpty():
        first = edges.select("before").distinct().join(edges.select(F.col("id").alias("before")), "before", "left_anti")
        now = cut(edges.join(first, "before", "left_semi").select("id").distinct())
        gone = now if gone is None else gone.union(now)
        edges = cut(edges.join(now, "id", "left_anti").join(now.select(F.col("id").alias("before")), "before", "left_anti").select("id", "before"))
    return nodes.select("id") if gone is None else nodes.select("id").join(gone, "id", "left_anti")


def _linked(raws: DataFrame, there: DataFrame, threshold: float) -> DataFrame:
    """(canonical_hash, event_id, founds) of raws (block, key, title, start_us, all_day, seq) against candidates of their blocks and each other.

    Raws of one block, title, start and kind are a class. Only its first raw can
    found: what that one links to stays a candidate for all later ones. So
    founders are the classes that one pass in feed order would keep, and each
    raw then takes the best of the candidates and founders before it.
    """
    one = ["block", "title", "start_us", "all_day"]
    classes = cut(raws.groupBy(*one).agg(F.min_by("key", F.struct("seq", "key")).alias("key"), F.min("seq").alias("seq"), F.max("seq").alias("last")))
    known = there.groupBy("block", "title", "start_us", "seq").agg(F.min("key").alias("key")).withColumn("settled", F.lit(True))
    both = known.unionByName(classes.select("block", "title", "start_us", "seq", "key", F.lit(False).alias("settled")))
    edges = cut(_scored(classes, both, threshold))
    early = edges.where("known_seq < first")
    taken = early.where("settled").select("id").distinct()
    open_ = classes.select(F.col("key").alias("id")).join(taken, "id", "left_anti")
    founders = first_come(open_, early.where("not settled").select("id", F.col("known_key").alias("before")).join(open_, "id", "left_semi").join(open_.select(F.col("id").alias("before")), "before", "left_semi"))
    founders = founders.select(F.col("id").alias("known_key"))
    good = edges.where("settled").drop("settled").unionByName(edges.where("not settled").drop("settled").join(founders, "known_key", "left_semi"))
    own = classes.join(founders, classes["key"] == founders["known_key"], "left_semi").select(F.col("key").alias("id"), F.col("seq").alias("first"), F.col("key").alias("known_key"), F.col("seq").alias("known_seq"), F.lit(1.0).alias("ratio"))
    good = good.unionByName(own).select("id", "known_key", "known_seq", "ratio")
    each = raws.join(classes.select(*one, F.col("key").alias("id")), one).select("id", "key", "seq")
    best = each.join(good, "id").where("known_seq < seq").groupBy("key").agg(F.min_by("known_key", F.struct(-F.col("ratio"), F.col("known_key"))).alias("best"))
    out = each.select("key").join(best, "key", "left")
    return out.select(F.col("key").alias("canonical_hash"), F.coalesce("best", "key").alias("event_id"), F.col("best").isNull().alias("founds"))


def link_misses(misses: DataFrame, events: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(canonical_hash, event_id, founds) of raws whose hash is new; a founder's event_id is its hash.

    Same as taking raws one after another in feed order, each looking at the
    events of before and at those founded earlier in the run: raws with a venue
    only meet in blocks of a UTC date and a venue; then raws with a time but no
    venue in blocks of one start, whose candidates are all events there and
    founders with a smaller seq. All-day raws without a venue always found.
    Candidates have their status, start and venue of before the run, and equal
    ratios go to the smallest key. Distinct titles of a block meet by a join,
    which adaptive execution can split; no task holds a block.
    """
    title, start = text.key_text(F.col("title")).alias("title"), F.unix_micros("start_at").alias("start_us")
    block = lambda *c: F.unhex(F.sha1(F.concat_ws("|", *c))).alias("block")
    raws = misses.select(F.col("canonical_hash").alias("key"), title, start, "all_day", "seq", venue_key(F.col("venue_name")).alias("venue"), block_date(F.col("all_day"), F.col("start_local_date"), F.col("start_at")).alias("day"))
    there = events.where("status != 'removed'").select(F.col("event_id").alias("key"), title, start, "all_day", F.lit(_BEFORE).alias("seq"), text.key_text(F.col("venue_name")).alias("venue"), F.to_date("start_at").alias("day"))
    raws, there = cut(raws), cut(there)  # each step below reads them
    cols = ["key", "title", "start_us", "all_day", "seq"]
    at_venue = lambda df: df.where("venue != ''").select(block(F.col("day").cast("string"), "venue"), *cols)
    first = cut(_linked(at_venue(raws), at_venue(there), threshold))
    founders = raws.where("venue != ''").join(first.where("founds").select(F.col("canonical_hash").alias("key")), "key", "left_semi")
    bare = raws.where("venue = '' and not all_day")
    at_start = lambda df: df.select(block(F.col("start_us").cast("string")), *cols)
    known = there.unionByName(founders)
    known = known.join(bare.select("start_us").distinct(), "start_us", "left_semi")
    second = _linked(at_start(bare), at_start(known), threshold)
    alone = raws.where("venue = '' and all_day").select(F.col("key").alias("canonical_hash"), F.col("key").alias("event_id"), F.lit(True).alias("founds"))
    return first.union(second).union(alone)
