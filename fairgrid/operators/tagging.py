"""Category tags: which events want them, batches for a classifier, its answers, and how good they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import taxonomy, text
from .numbering import dense

MIN_DESCRIPTION, BATCH, SHARDS = 80, 25, 64


def untagged(events: DataFrame) -> DataFrame:
    return events.where((F.col("status") == "active") & (F.coalesce(F.size("categories"), F.lit(0)) <= 0))


def payload(title: Column, description: Column, venue: Column) -> Column:
    """JSON of title, stripped description and venue, if there is one; null for descriptions under 80 characters."""
    body = text.strip(description)
    return F.when(F.length(body) >= MIN_DESCRIPTION, F.to_json(F.struct(title.alias("title"), body.alias("description"), text.blank_as_null(venue).alias("venue"))))


def numbered(rows: DataFrame, key: str = "event_id", size: int = BATCH, shards: int = SHARDS) -> DataFrame:
    """Adds batch_id and idx (0 to size - 1), numbered by key inside shards by the key's MD5, so that no task sees all rows."""
    shard = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards))
    n = F.row_number().over(Window.partitionBy("shard").orderBy(key)) - 1
    out = rows.withColumn("shard", shard).withColumn("n", n)
    return out.withColumn("batch_id", F.floor(F.col("n") / size) * shards + F.col("shard")).withColumn("idx", (F.col("n") % size).cast("int")).drop("n", "shard")


def numbered_in_order(rows: DataFrame, key: str = "event_id", size: int = BATCH) -> DataFrame:
    """Adds batch_id and idx by the order of ``key``, which tells rows apart, over the whole table: every batch is full but the last."""
    out = dense(rows, [key], "n")
    return out.withColumn("batch_id", F.floor(F.col("n") / size)).withColumn("idx", (F.col("n") % size).cast("int")).drop("n")


def batches(rows: DataFrame) -> DataFrame:
    """(batch_id, request): a line of JSON with its id per row, in order; a batch has BATCH rows at most."""
    line = F.concat(F.lit('{"id":"'), F.col("idx").cast("string"), F.lit('",'), F.substr("payload", F.lit(2)))
    listed = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return rows.groupBy("batch_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("request"))


def classify(requests: DataFrame, classifier: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(batch_id, response, failed) by a function over lists of requests; a None response is a failed batch."""

    @F.pandas_udf(T.StringType())
    def ask(request):
        import pandas as pd

        return pd.Series(classifier(request.tolist()), dtype="object")

    return requests.select("batch_id", ask("request").alias("response")).withColumn("failed", F.col("response").isNull())


def parse_compact(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Lines "id:Tag,Tag" to (keys, idx, tags): tags of the taxonomy only, the last line of an id wins."""
    lines = responses.select(*keys, F.posexplode(F.split("response", r"\R")).alias("line_no", "line"))
    lines = lines.withColumn("line", text.strip("line")).where(F.contains("line", F.lit(":")))
    tags = F.transform(F.split(F.substr("line", F.instr("line", ":") + 1), ","), text.strip)
    lines = lines.select(*keys, text.strip(F.substring_index("line", ":", 1)).alias("idx"), "line_no", taxonomy.strict(tags).alias("tags"))
    return lines.groupBy(*keys, "idx").agg(F.max_by("tags", "line_no").alias("tags"))


def parse_json(responses: DataFrame, keys: list[str]) -> DataFrame:
    """A JSON object id -> list to (keys, idx, tags); what isn't a list is ignored, bad text gives nothing."""
    each = responses.select(*keys, F.explode(F.from_json("response", "map<string,string>")).alias("idx", "value"))
    tags = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", "array<string>"))
    return each.select(*keys, "idx", taxonomy.strict(tags).alias("tags")).where("tags is not null")


def write_back(events: DataFrame, placed: DataFrame, predictions: DataFrame) -> DataFrame:
    """Events with predicted categories where there are any; placed: (event_id, batch_id, idx)."""
    p = predictions.select("batch_id", F.col("idx").try_cast("int").alias("idx"), "tags").where("size(tags) > 0")
    found = placed.select("event_id", "batch_id", "idx").join(p, ["batch_id", "idx"]).select("event_id", "tags")
    return events.join(found, "event_id", "left").withColumn("categories", F.coalesce("tags", "categories")).drop("tags")


def tagging_stats(candidates: DataFrame, placed: DataFrame, predictions: DataFrame) -> DataFrame:
    """tagged, skipped_no_description, candidates, batches."""
    p = predictions.select("batch_id", F.col("idx").try_cast("int").alias("idx"), "tags").where("size(tags) > 0")
    tagged = placed.join(p, ["batch_id", "idx"], "left_semi").agg(F.count("*").alias("tagged"))
    all_ = candidates.agg(F.count_if(F.col("payload").isNull()).alias("skipped_no_description"), F.count("*").alias("candidates"))
    return tagged.crossJoin(all_).crossJoin(placed.agg(F.count_distinct("batch_id").alias("batches")))


def evaluation_sample(events: DataFrame, n: int) -> DataFrame:
    """The first n active, tagged events by id with a payload, looked for among 4 n."""
    some = events.where((F.col("status") == "active") & (F.size("categories") > 0)).orderBy("event_id").limit(4 * n)
    return some.withColumn("payload", payload(F.col("title"), F.col("description"), F.col("venue_name"))).where("payload is not null").orderBy("event_id").limit(n)


def set_metrics(predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two tag sets; an empty prediction is precise, an empty truth is recalled."""
    empty = F.array().cast("array<string>")
    a, b = F.array_distinct(F.coalesce(predicted, empty)), F.array_distinct(F.coalesce(truth, empty))
    both = F.size(F.array_intersect(a, b))
    no_a, no_b = F.size(a) == 0, F.size(b) == 0
    p = F.when(no_a & no_b, 1.0).when(no_b, 0.0).when(no_a, 1.0).otherwise(both / F.size(a))
    r = F.when(no_b, 1.0).when(no_a, 0.0).otherwise(both / F.size(b))
    f = F.when(no_a & no_b, 1.0).when(no_a | no_b | (both == 0), 0.0).otherwise(2 * p * r / (p + r))
    return p, r, f


def evaluate(truth: DataFrame, predictions: DataFrame, run_keys: list[str]) -> DataFrame:
    """Macro averages per run over all of ``truth`` (item, tags; one row an item); a missing prediction counts as empty.

    Items that a run doesn't answer are counted, not listed: an empty
    prediction is precise, and recalls no truth but an empty one. Predictions
    of items that aren't in ``truth`` don't count.
    """
    empty = F.array().cast("array<string>")
    known = truth.select("item", F.coalesce("tags", empty).alias("truth"))
    got = predictions.select(*run_keys, "item", F.coalesce("tags", empty).alias("predicted")).join(known, "item", "left")
    p, r, f = set_metrics(F.col("predicted"), F.col("truth"))
    there, none = F.col("truth").isNotNull(), F.size("truth") == 0
    if_there = lambda x: F.coalesce(F.sum(F.when(there, x)), F.lit(0))
    sums = [F.count_if(there).alias("n"), if_there(F.size("predicted")).alias("cats"), if_there(p).alias("p"), if_there(r).alias("r"), if_there(f).alias("f")]
    by_item = got.groupBy(*run_keys, "item").agg(*sums, F.max(there & none).alias("none"))
    runs = by_item.groupBy(*run_keys).agg(*[F.sum(c).alias(c) for c in ("n", "cats", "p", "r", "f")], F.count_if(F.col("n") > 0).alias("found"), F.count_if("none").alias("found_empty"))
    whole = known.agg(F.count("*").alias("items"), F.count_if(none).alias("empty"))
    runs = runs.crossJoin(F.broadcast(whole)).where("items > 0")  # one row
    missing, missing_empty = F.col("items") - F.col("found"), F.col("empty") - F.col("found_empty")
    n = F.col("n") + missing
    averages = [(F.col("cats") / n).alias("avg_cats"), ((F.col("p") + missing) / n).alias("precision"), ((F.col("r") + missing_empty) / n).alias("recall"), ((F.col("f") + missing_empty) / n).alias("f1")]
    return runs.select(*run_keys, n.alias("n_items"), *averages)


def usage_cost(usage: DataFrame, prices: DataFrame, run_keys: list[str]) -> DataFrame:
    """Token sums and cost per run; prices: (model, input_price, output_price) per million tokens, 0 for a model that isn't there."""
    kinds = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")
    total = usage.groupBy(*run_keys).agg(*[F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in kinds])
    got = total.join(prices, "model", "left")
    i, o = F.coalesce("input_price", F.lit(0.0)), F.coalesce("output_price", F.lit(0.0))
    parts = [F.col(k) / 1e6 * price for k, price in zip(kinds, (i, i * 1.25, i * 0.1, o), strict=True)]
    return got.withColumn("cost", parts[0] + parts[1] + parts[2] + parts[3]).select(*run_keys, *kinds, "cost")
