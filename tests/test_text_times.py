import datetime as dt

import pytest
from pyspark.sql import functions as F

from fairgrid.functions import taxonomy, text, times
from fairgrid.operators import geocode
from fairgrid.sources import feeds, json_docs

L = lambda x, t="string": F.lit(x).cast(t)


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_html(spark):
    got = values(spark, *[text.clean_html(L(s)) for s in ("<p>A&nbsp;&amp;  B</p><p>C<br/>D</p>", "&lt;b&gt;x", "", None, "a\n\n\n\nb<BR >c", "<script>var t</script>")])
    assert got == ["A & B\n\nC\nD", "x", "", None, "a\n\nb\nc", "var t"]


def test_ended_references(spark):
    texts = ("<h1>A&amp;&amp</h1>&lt;i&gt;b&copy c&#38;amp;", "&amp;amp &notit; &#x26; &#38 &a&;", "no reference", None, "\ufdd0&amp;\ufdd0\ufdd1&\ufdd0\ufdd2&amp")
    got = values(spark, *[text.clean_html(L(s), text.unescape_ended) for s in texts])
    assert got == ["A&&amp\n\nb&copy c&amp;", "&amp &notit; & &#38 &a&;", "no reference", None, "\ufdd0&\ufdd0\ufdd1&\ufdd0\ufdd2&amp"]
    assert values(spark, text.clean_html(L("A&amp</p>")))[0] == "A&"


def test_html_with_cut_references(spark, tmp_path):
    """The registered query over pages that were cut inside of a reference, against its SQL."""
    import duckdb

    import __spark_entry__ as entry

    pages = ["<title>A &amp;&amp;&amp; b&amp</title><p>&amp;amp c &copy d &quot &am &a & &copy; &quot;x&quot;</p>", "whole", "&middot; e &ampf;"]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select page_id, body_sha256, n from ({entry.oracle_sql()['p1_clean_html']}) order by 1").fetchall()
    got = entry.queries()["p1_clean_html"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert len(want) == len(pages) and [(r.page_id, r.body_sha256, r.n) for r in got] == want


def test_hash(spark):
    import hashlib

    d = L("2026-06-15", "date")
    got = values(spark, text.canonical_hash(L(" Concert in the Park\t"), d, L("Garner Park")), text.canonical_hash(L("X"), d, L(None)))
    want = [hashlib.sha256(s.encode()).hexdigest() for s in ("concert in the park|2026-06-15|garner park", "x|2026-06-15|")]
    assert got == want


def test_small_text_functions(spark):
    got = values(
        spark,
        *[text.cost_indicator(L(s)) for s in ("Free entry, $5 parking", "$5", "freedom", None, "éfree")],
        text.address_line(L("1 Main"), L("Springfield"), L("IL"), L("53703")),
        text.address_line(L(""), L(None), L(""), L("")),
        text.escape_ical(L("a,b;c\nd")),
        text.ical_filename(L("Jazz & Blues!")),
        *[text.is_http_url(L(s)) for s in ("HTTPS://x.y", "ftp://x.y", "javascript:alert(1)", None)],
        text.location_label(L(""), L("1 Main")),
    )
    assert got == ["free", "paid", None, None, "free", "1 Main, Springfield, IL 53703", None, "a\\,b\\;c\\nd", "jazz-blues.ics", True, False, False, False, "1 Main"]


def test_all_day_description(spark):
    cases = [("", "Some description"), ("7pm-9pm", "Great event"), ("7pm-9pm", None), ("See event description for times", "My desc"), ("SEE EVENT DESCRIPTION", "My desc"), ("", None)]
    got = values(spark, *[text.all_day_description(L(a), L(b)) for a, b in cases])
    assert got == ["Some description", "7pm-9pm — Great event", "7pm-9pm", "My desc", "My desc", None]


def test_lookup_key(spark):
    f = lambda n, a: geocode.lookup_key(L(n), L(a), "springfield", "springfield, il")
    got = values(spark, f("x", " 25  S Main St "), f("x", "1 Springfield Ave"), f("The  Hall", None), f("The  Hall", "  "), f(None, None), geocode.lookup_text(L("the hall | springfield, il"), "springfield, il"))
    assert got == ["25 s main st, springfield, il", "1 springfield ave", "the hall | springfield, il", "the hall | springfield, il", None, "the hall, springfield, il"]


def test_rss_title(spark):
    got = []
    for t in ("Jazz Night - June 1 7 pm @ The Bar", "Jazz", "A - B - June 1"):
        got.append(tuple(values(spark, *feeds.split_title(L(t)))))
    assert got == [("jazz night", "the bar"), ("jazz", ""), ("a", "")]


def test_clock_parsers(spark):
    hms = ["18:30:00", "", None, "24:00:00", "1:2:3", "12:00", "a:b:c"]
    clock = ["6:30pm", "6pm", "12am", "12:15PM", "13pm", "", "06:05am"]
    got = values(spark, *[times.parse_hms(L(s)) for s in hms], *[times.parse_clock(L(s)) for s in clock])
    assert got == [66600, None, None, None, 3723, None, None, 66600, 64800, 0, 44100, None, None, 21900]
    iso = values(spark, *[times.parse_iso(L(s)).isNotNull() for s in ("2026-05-04T06:00:00Z", "2026-04-27", "2026", "12:00", "", None, "2026-13-40")])
    assert iso == [True, True, False, False, False, False, False]


@pytest.mark.parametrize(
    "said,want",
    [
        ("From: 06:00 PM to 08:30 PM", ("2026-05-08T23:00", "2026-05-09T01:30")),
        ("Doors open at 7pm", (None, None)),
        ("From: 11:00 PM to 01:00 AM", ("2026-05-09T04:00", "2026-05-09T06:00")),
        ("from: 02:00 pm to 04:00 pm", ("2026-05-08T19:00", "2026-05-08T21:00")),
        ("From: 6:30 PM to 8:00 PM", ("2026-05-08T23:30", "2026-05-09T01:00")),
        ("From: 06:30PM to 08:00PM", (None, None)),
    ],
)
def test_from_to(spark, said, want):
    d = L("2026-05-08", "date")
    got = values(spark, *times.span(d, *times.from_to(L(said))))
    assert got == [w and ts(w) for w in want]


@pytest.mark.parametrize(
    "said,first,last,want",
    [
        ("", "2026-05-04", "2026-05-10", []),
        ("Friday 6:30pm-7:30pm", None, None, []),
        ("Friday 6:30pm-7:30pm", "2026-05-04", "2026-05-04", []),
        ("Friday 6:30pm-7:30pm", "2026-05-04", "2026-05-10", [("2026-05-08", 66600, 70200)]),
        ("Friday 6:30pm-7:30pm", "2026-05-01", "2026-05-14", [("2026-05-01", 66600, 70200), ("2026-05-08", 66600, 70200)]),
        ("Friday 6:30pm-7:30pm, Saturday 11am-12pm", "2026-05-04", "2026-05-10", [("2026-05-08", 66600, 70200), ("2026-05-09", 39600, 43200)]),
        ("Friday 11pm-1am", "2026-05-04", "2026-05-10", [("2026-05-08", 82800, 3600)]),
        ("Mondays 6pm-7pm", "2026-05-04", "2026-05-10", []),
        ("Friday 6:30-7:30pm", "2026-05-04", "2026-05-10", []),
        ("sat 11am–12pm", "2026-05-04", "2026-05-10", [("2026-05-09", 39600, 43200)]),
        ("Friday 6pm-7pm", "2026-05-10", "2026-05-04", []),
    ],
)
def test_weekdays(spark, said, first, last, want):
    (got,) = values(spark, times.weekday_occurrences(L(said), L(first, "date"), L(last, "date")))
    assert [(str(x.d), x.start, x.end) for x in got or []] == want


def test_clock_changes_and_window_bound(spark):
    got = values(spark, times.at_clock(L("2026-03-08", "date"), F.lit(9000)), times.at_clock(L("2026-11-01", "date"), F.lit(5400)), times.window_bound(L("2026-04-27", "date")))
    assert got == [ts("2026-03-08T08:30"), ts("2026-11-01T06:30"), "2026-04-27T05:00:00.000Z"]


def test_json_docs(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        """{"title": " Show ", "dates": {"eventDate": "2026-05-09T04:59:59Z"}, "startTime": "23:00:00", "endTime": "01:00:00", "location": "", "categories": [{"catName": "Trivia"}, {"catName": "Nope"}], "media_raw": [{"mediaurl": "https://i/1"}], "url": "/x", "teaser": "<b>T</b>"}
{"title": "", "startDate": "2026-05-08T06:00:00Z"}
{"title": "No date"}
{"title": "Series", "startDate": "2026-05-01T06:00:00Z", "endDate": "2026-05-14T06:00:00Z", "times": "Friday 6:30pm-7:30pm"}
{"title": "Open", "startDate": "2026-05-08T06:00:00Z", "times": "Doors early", "description": "D", "extra": 1}
"""
    )
    docs = json_docs.read(spark, str(tmp_path))
    rows = sorted(json_docs.raw_events(docs, "S", "https://d/").collect(), key=lambda r: (r.title, r.start_at))
    assert [(r.title, str(r.start_at), str(r.end_at), r.all_day, r.description, r.source_url) for r in rows] == [
        ("Open", "2026-05-08 05:00:00", "None", True, "Doors early — D", "https://d/"),
        ("Series", "2026-05-01 23:30:00", "2026-05-02 00:30:00", False, None, "https://d/"),
        ("Series", "2026-05-08 23:30:00", "2026-05-09 00:30:00", False, None, "https://d/"),
        ("Show", "2026-05-09 04:00:00", "2026-05-09 06:00:00", False, "T", "/x"),
    ]
    show = rows[-1]
    assert (show.venue_name, show.categories, show.image_url, str(show.start_local_date)) == (None, ["Trivia & Games"], "https://i/1", "2026-05-08")
    none = json_docs.raw_events(docs, "S", "https://d/", window=("2026-05-09", "2026-06-08"))
    assert none.count() == 0


def test_taxonomy(spark):
    got = values(spark, taxonomy.map_categories(F.array(L("Trivia"), L(None), L("Local Libations"), L("Food & Drink"))), taxonomy.strict(F.array(L("Music"), L("Nope"), L("Music"))))
    assert got == [["Trivia & Games", "Food & Drink"], ["Music", "Music"]]
