"""RSS items and crawled pages, and with calendar rows the events of a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, times
from ..functions.schemas import RSS_ITEMS
from . import calendar_text
from .ordered import in_order

#: Descriptions below this length are looked up on the event's page.
SHORT = 80


# -- RSS ----------------------------------------------------------------------


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """(seq, title, link) of the items, seq in the order of files and items."""
    items = in_order(spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEMS).load(path))
    return items.select("seq", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("link", F.lit("")).alias("link"))


def split_title(title: Column) -> tuple[Column, Column]:
    """Name before the first " - " and venue after the last " @ " of what follows, both normalised."""
    at = F.instr(title, " - ")
    rest = F.when(at > 0, F.substr(title, at + 3)).otherwise("")
    venue = F.when(F.contains(rest, F.lit(" @ ")), F.substring_index(rest, " @ ", -1)).otherwise("")
    return text.key_text(F.substring_index(title, " - ", 1)), text.key_text(venue)


def occurrence_date(link: Column) -> Column:
    """Date of the link's occ_dtstart parameter; null without one."""
    found = F.try_parse_url(link, F.lit("QUERY"), F.lit("occ_dtstart"))
    return F.when(F.substring(found, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(found, 1, 10).try_cast("date"))


def url_maps(items: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Links by (title, date, venue), the last one of each, and by (title, date), the first one."""
    name, venue = split_title(F.col("title"))
    rows = items.select("seq", "link", name.alias("t"), venue.alias("v"), occurrence_date(F.col("link")).alias("d"))
    rows = rows.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    exact = rows.where("v != ''").groupBy("t", "d", "v").agg(F.max_by("link", "seq").alias("exact_url"))
    loose = rows.groupBy("t", "d").agg(F.min_by("link", "seq").alias("loose_url"))
    return exact, loose


def resolve_urls(events: DataFrame, exact: DataFrame, loose: DataFrame, tz: str = times.HOME) -> DataFrame:
    """Adds source_url: by title, local date and venue, else by title and date; rows with neither go."""
    keys = {"t": text.key_text(F.col("title")), "d": times.local_date(F.col("start_at"), tz), "v": text.key_text(F.coalesce("venue_name", F.lit("")))}
    found = events.withColumns(keys).join(exact, ["t", "d", "v"], "left").join(loose, ["t", "d"], "left")
    url = F.coalesce(text.blank_as_null(F.col("exact_url")), text.blank_as_null(F.col("loose_url")))
    return found.withColumn("source_url", url).where("source_url is not null").drop("t", "d", "v", "exact_url", "loose_url")


# -- crawled pages ------------------------------------------------------------


def page_text_udf(container: str, attribute: str | None = "id", ended: bool = False):
    """html -> text of the first element whose ``attribute`` is ``container`` (or whose tag it is, without an attribute); null if none.

    ended: only references that end in a semicolon are decoded.
    """
    guard, restore = text.ended_only() if ended else (str, str)

    @F.pandas_udf(T.StringType())
    def page_text(html):
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.depth, self.done, self.parts, self.tag = 0, False, [], None

            def handle_starttag(self, tag, attrs):
                if self.done:
                    return
                if self.depth:
                    self.depth += tag == self.tag
                elif (tag == container) if attribute is None else restore(dict(attrs).get(attribute) or "") == container:
                    self.depth, self.tag = 1, tag

            def handle_endtag(self, tag):
                if self.depth and tag == self.tag:
                    self.depth -= 1
                    self.done = self.depth == 0

            def handle_data(self, data):
                if self.depth:
                    self.parts.append(data)

        def read(page):
            if page is None:
                return None
            r = Reader()
            r.feed(guard(page))
            r.close()
            return restore(" ".join(" ".join(r.parts).split())) or None

        return html.map(read)

    return page_text


def enrich(events: DataFrame, pages: DataFrame, container: str = "content", attribute: str | None = "id", ended: bool = False) -> DataFrame:
    """Short descriptions are replaced by their page's text, where there is one; adds ``enriched`` (null: it wasn't short).

    Only short rows' addresses meet the pages, and only these pages are parsed (``ended`` as in page_text_udf).
    """
    short = F.length(F.coalesce("description", F.lit(""))) < SHORT
    wanted = events.where(short).select(F.col("source_url").alias("url")).distinct()
    found = pages.select("url", "html").join(wanted, "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    found = found.select(F.col("url").alias("page_url"), page_text_udf(container, attribute, ended)("html").alias("page_text"))
    looked = F.when(short, F.col("source_url"))
    out = events.withColumn("looked", looked).join(found, F.col("looked") == F.col("page_url"), "left")
    out = out.withColumn("enriched", F.when(F.col("looked").isNotNull(), F.col("page_text").isNotNull()))
    return out.withColumn("description", F.coalesce("page_text", "description")).drop("looked", "page_url", "page_text")


def enrichment_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count("enriched").alias("short"), F.count_if(F.col("enriched")).alias("enriched"), F.count_if(~F.col("enriched")).alias("failed"))


def feed_events(rows: DataFrame, items: DataFrame, source_name: str, start: str, end: str, tz: str = times.HOME) -> DataFrame:
    """Calendar rows with titles, expanded in [start, end], with their RSS addresses, as raw events."""
    out = calendar_text.expand(rows.where("summary is not null"), start, end, tz)
    out = out.withColumnsRenamed({"summary": "title", "location": "venue_name"})
    out = resolve_urls(out, *url_maps(items, start, end), tz)
    none = F.lit(None).cast("string")
    return out.select("seq", "title", "start_at", times.local_date(F.col("start_at"), tz).alias("start_local_date"), F.lit(source_name).alias("source_name"), "source_url", "description", "end_at", "venue_name", none.alias("venue_address"), none.alias("image_url"), F.array().cast("array<string>").alias("categories"), F.lit(False).alias("all_day"))
