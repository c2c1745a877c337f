import datetime as dt

from pyspark.sql import functions as F

from fairgrid.sources import calendar_text, feeds

RSS = """<?xml version="1.0"?><rss><channel>
<item><title>Jazz - June 1 7 pm @ The Bar</title><link>https://e.com/a?occ_dtstart=2026-06-01T19:00</link></item>
<item><title>Jazz - June 1 9 pm @ The Bar</title><link>https://e.com/b?occ_dtstart=2026-06-01T21:00</link></item>
<item><title>Jazz - June 1 @ Hall</title><link>https://e.com/c?occ_dtstart=2026-06-01</link></item>
<item><title>Walk</title><link>https://e.com/none</link></item>
<item><title>Late - x</title><link>https://e.com/d?occ_dtstart=2026-09-01</link></item>
</channel></rss>"""

ICAL = "\r\n".join(
    """BEGIN:VCALENDAR
BEGIN:VEVENT
SUMMARY: Jazz
DTSTART;TZID=America/Chicago:20260601T190000
DTEND;TZID=America/Chicago:20260601T210000
LOCATION:The Bar
DESCRIPTION:One\\, two\\nthr
 ee
END:VEVENT
BEGIN:VEVENT
SUMMARY:Jazz
DTSTART:20260602T000000Z
LOCATION:Elsewhere
END:VEVENT
BEGIN:VEVENT
SUMMARY:
DTSTART;VALUE=DATE:20260601
END:VEVENT
BEGIN:VEVENT
SUMMARY:Nowhere
DTSTART;VALUE=DATE:20260601
END:VEVENT
END:VCALENDAR""".split("\n")
)


def test_feed(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "i").mkdir()
    (tmp_path / "r/feed.xml").write_text(RSS)
    (tmp_path / "i/cal.ics").write_text(ICAL)
    items, rows = feeds.read_rss(spark, str(tmp_path / "r")), calendar_text.rows(calendar_text.read(spark, str(tmp_path / "i")))
    got = rows.orderBy("seq").collect()
    assert [(r.summary, str(r.dtstart), str(r.dtend), r.description) for r in got[:2]] == [("Jazz", "2026-06-02 00:00:00", "2026-06-02 02:00:00", "One, two\nthree"), ("Jazz", "2026-06-02 00:00:00", "None", None)]
    assert got[2].summary is None and str(got[3].dtstart) == "2026-06-01 05:00:00"
    out = feeds.feed_events(rows, items, "Feed", "2026-06-01", "2026-07-01").orderBy("seq").collect()
    # the last link of the venue, else the first of title and date; no link, no event
    assert [(r.venue_name, r.source_url, str(r.start_local_date)) for r in out] == [("The Bar", "https://e.com/b?occ_dtstart=2026-06-01T21:00", "2026-06-01"), ("Elsewhere", "https://e.com/a?occ_dtstart=2026-06-01T19:00", "2026-06-01")]


def series(spark, rule, start="2026-03-02 19:00", hours=2, exdate=()):
    s = dt.datetime.fromisoformat(start)
    rows = [(1, "x", s, s + dt.timedelta(hours=hours), None, None, rule, list(exdate))]
    df = spark.createDataFrame(rows, "seq long, summary string, dtstart timestamp, dtend timestamp, location string, description string, rrule string, exdate array<string>")
    return [str(r.start_at)[5:16] for r in calendar_text.expand(df, "2026-03-06", "2026-03-20").orderBy("start_at").collect()]


def test_recurrence(spark):
    # 19:00 UTC is 13:00 in winter time, and stays 13:00 after the change of 8 March
    assert series(spark, "FREQ=DAILY;INTERVAL=4") == ["03-06 19:00", "03-10 18:00", "03-14 18:00", "03-18 18:00"]
    assert series(spark, "FREQ=DAILY;COUNT=6") == ["03-06 19:00", "03-07 19:00"]
    assert series(spark, "FREQ=WEEKLY;BYDAY=MO,WE") == ["03-09 18:00", "03-11 18:00", "03-16 18:00", "03-18 18:00"]
    assert series(spark, "FREQ=WEEKLY;INTERVAL=2") == ["03-16 18:00"]
    assert series(spark, "FREQ=MONTHLY;BYDAY=2MO") == ["03-09 18:00"]
    assert series(spark, "FREQ=MONTHLY;BYDAY=-3TH") == ["03-12 18:00"]
    assert series(spark, "FREQ=MONTHLY;BYDAY=2MO,3TH,-3WE") == ["03-09 18:00", "03-11 18:00", "03-19 18:00"]
    assert series(spark, "FREQ=MONTHLY;BYDAY=MO") == ["03-09 18:00", "03-16 18:00"]
    assert series(spark, "FREQ=MONTHLY;BYMONTHDAY=15,-20") == ["03-12 18:00", "03-15 18:00"]
    assert series(spark, "FREQ=DAILY;BYDAY=MO,SA") == ["03-07 19:00", "03-09 18:00", "03-14 18:00", "03-16 18:00"]
    assert series(spark, "FREQ=YEARLY", "2024-03-10 18:00") == ["03-10 18:00"] and series(spark, "FREQ=YEARLY;INTERVAL=3", "2024-03-10 18:00") == []
    assert series(spark, "FREQ=YEARLY;BYMONTH=3;BYMONTHDAY=9") == ["03-09 18:00"]
    assert series(spark, "FREQ=MONTHLY;BYDAY=MO;BYSETPOS=2") == ["03-09 18:00"]
    rules = spark.createDataFrame([("FREQ=MONTHLY;BYDAY=MO;BYSETPOS=1",), ("FREQ=YEARLY;BYDAY=MO",), ("FREQ=HOURLY",), ("FREQ=MONTHLY;BYDAY=1MO",), ("FREQ=DAILY;COUNT=3",), (None,)], "rrule string")
    assert {r.rrule for r in calendar_text.unknown_rules(rules).collect()} == {"FREQ=HOURLY"}
    assert series(spark, "FREQ=WEEKLY;UNTIL=20260310T000000Z", exdate=["20260309T130000"]) == []
    assert series(spark, None) == [] and series(spark, None, "2026-03-07 10:00") == ["03-07 10:00"]
    assert series(spark, None, "2026-03-05 10:00", 48) == ["03-05 10:00"]


def test_enrichment(spark):
    e = spark.createDataFrame([("short", "u1"), (None, "u2"), ("x" * 80, "u1"), ("short", "u3")], "description string, source_url string")
    pages = spark.createDataFrame([("u1", "<div id='content'>Full <b>text</b>&amp; <div>in</div></div> out"), ("u2", "<p>none</p>")], "url string, html string")
    out = feeds.enrich(e, pages)
    assert tuple(feeds.enrichment_stats(out).first()) == (3, 1, 2)
    assert out.where("enriched").select(F.col("description")).first()[0] == "Full text & in"


CUT = [
    "<article><h1>A &amp;&amp;&amp; b&amp</h1><p>&amp;amp c &copy d &quot &am &a &; & &amp; &copy; &middot; &quot;x&quot;</p></article>",
    "<p>before &amp</p><article>e &ampf; &copy\n</article>",
    "<article>\ufdd0&amp\ufdd0\ufdd1\ufdd2&amp;\ufdd0\ufdd2</article>",
    "<article>whole</article>",
]


def same_as_sql(spark, tmp_path, name):
    """Rows of a registered query over pages with references cut off, those of its SQL."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(CUT)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select page_id, body_sha256, n from ({entry.oracle_sql()[name]}) order by 1").fetchall()
    got = entry.queries()[name](spark, str(tmp_path)).orderBy("page_id")
    assert len(want) == len(CUT) and [tuple(r) for r in got.select("page_id", "body_sha256", "n").collect()] == want


def test_page_text_with_cut_references(spark, tmp_path):
    same_as_sql(spark, tmp_path, "s5_page_text")


def test_ended_references_of_a_page(spark):
    pages = spark.createDataFrame([("<div id='a&b'>x&amp <i>y&lt;z&#38;amp;&nbsp;&notit;</i><script>p&amp;&amp q</script></div>",)], "html string")
    read = lambda **ended: pages.select(feeds.page_text_udf("a&b", **ended)("html")).first()[0]
    assert read(ended=True) == "x&amp y<z&amp; &notit; p&amp;&amp q"
    assert read() == "x& y<z&amp; ¬it; p&amp;&amp q"
