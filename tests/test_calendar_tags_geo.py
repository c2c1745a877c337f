import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fairgrid.functions.schemas import EVENTS, VENUE_GEOCODES
from fairgrid.operators import calendar, dedupe, export, geocode, tagging
from fairgrid.sources import store

D = dt.date(2026, 6, 15)


def at(day, clock):
    """Local time of D + day in Chicago summer time, as UTC."""
    h, m = map(int, clock.split(":"))
    return dt.datetime(2026, 6, 15, h, m) + dt.timedelta(days=day, hours=5)


def event(i, start, end=None, **more):
    row = {"event_id": f"e{i}", "title": f"T{i}", "description": None, "start_at": start, "end_at": end, "venue_name": None, "venue_address": None, "latitude": None, "longitude": None, "categories": [], "image_url": None, "all_day": False, "canonical_hash": f"h{i}", "status": "active", "created_at": None, "updated_at": None}
    return row | more


def table(spark, rows):
    cols = [c.split()[0] for c in EVENTS.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], EVENTS)


def test_partition_of_a_day(spark):
    cases = [
        (event(0, at(0, "09:00"), all_day=True), "allday", None),
        (event(1, at(0, "00:00")), "allday", None),
        (event(2, at(0, "00:00"), at(0, "00:00")), "allday", None),
        (event(3, at(0, "00:00"), at(1, "00:00")), "allday", None),
        (event(4, at(0, "00:00"), at(0, "02:00")), "night", 0),
        (event(5, at(-2, "18:00"), at(2, "18:00")), "allday", None),
        (event(6, at(-1, "22:00"), at(0, "02:00")), "dropped", None),
        (event(7, at(-1, "22:00"), at(0, "10:00")), "allday", None),
        (event(8, at(0, "05:00")), "morning", 5),
        (event(9, at(0, "12:00")), "afternoon", 12),
        (event(10, at(0, "17:00")), "evening", 17),
        (event(11, at(0, "21:00")), "night", 21),
        (event(12, at(0, "04:59")), "night", 4),
    ]
    e = table(spark, [c[0] for c in cases])
    days = calendar.event_days(e, str(D), str(D))
    g = calendar.with_groups(days)
    got = {r.event_id: (r.bucket, r.hour) for r in g.collect()}
    assert got == {c[0]["event_id"]: c[1:] for c in cases}
    assert calendar.on_day(e, str(D)).count() == len(cases)
    h = {r.hour: r.n for r in calendar.hour_histogram(g).collect()}
    assert len(h) == 24 and sum(h.values()) == 6 and h[0] == 1
    bars = {r.hour: (r.height, r.place) for r in calendar.bar_heights(calendar.hour_histogram(g)).collect()}
    assert bars[5] == (100.0, 0) and bars[4] == (100.0, 23) and bars[6][0] == 0
    assert calendar.bucket_counts(g).drop("day").first().asDict() == {"allday": 6, "morning": 1, "afternoon": 1, "evening": 1, "night": 3}
    groups = calendar.hour_groups(g).collect()
    assert {(r.hour, r.label) for r in groups if r.bucket == "night"} == {(0, "12 AM"), (4, "4 AM"), (21, "9 PM")}


def test_filters_and_sources(spark):
    e = table(spark, [event(0, at(0, "9:00"), categories=["Music"], venue_name="Bar"), event(1, at(0, "9:00"), venue_name="Hall"), event(2, at(0, "9:00"), categories=["Civic & Politics", "Dance"]), event(3, at(0, "9:00"), categories=["Civic & Politics"], venue_name="")])
    ids = lambda c: sorted(r.event_id for r in e.where(c).collect())
    assert ids(calendar.category_filter(F.col("categories"))) == ["e0", "e1", "e2"]
    assert ids(calendar.category_filter(F.col("categories"), include_untagged=False)) == ["e0", "e2"]
    assert ids(calendar.category_filter(F.col("categories"), [])) == ["e1"]
    assert ids(calendar.venue_filter(F.col("venue_name"), ["Bar"])) == ["e1"]
    assert len(ids(calendar.venue_filter(F.col("venue_name"), []))) == 4
    hidden = spark.createDataFrame([("Bar",)], "venue_name string")
    assert [r.event_id for r in calendar.without_venues(e, hidden).collect()] == ["e1"]
    s = spark.createDataFrame([("e0", n, f"u{n}") for n in ("Z", "Tourism", "Weekly", "Y")], "event_id string, source_name string, source_url string")
    out = {r.event_id: [x.source_name for x in r.sources] for r in calendar.with_sources(e, s, ["Weekly", "Tourism"]).collect()}
    assert out["e0"] == ["Weekly", "Tourism", "Y", "Z"] and out["e1"] == []


def test_a_pin_has_all_its_events(spark):
    d = calendar.event_days(table(spark, [event(i, at(0, "20:00"), latitude=43.0, longitude=-89.0) for i in range(120)]))
    assert sorted(r.place for r in calendar.pin_events(d).collect()) == list(range(1, 121))


def test_pins_and_serving(spark, tmp_path):
    e = table(spark, [event(i, at(0, f"{20 - i}:00"), latitude=43.0000001 * (i < 3) or None, longitude=-89.0 if i < 4 else None) for i in range(5)])
    d = calendar.event_days(e)
    (p,) = calendar.pins(d).collect()
    assert (p.pin, p.n, p.event_id) == ("43.00000,-89.00000", 3, "e2")
    assert [r.event_id for r in calendar.pin_events(d, 2).orderBy("place").collect()] == ["e2", "e1"]
    s = spark.createDataFrame([("e0", "A", "u")], "event_id string, source_name string, source_url string")
    store.write_days(calendar.with_sources(d, s, []), str(tmp_path / "out"))
    rows = [json.loads(line) for f in (tmp_path / "out/day=2026-06-15").glob("*.json") for line in f.read_text().splitlines()]
    assert [r["event_id"] for r in rows] == ["e4", "e3", "e2", "e1", "e0"] and rows[-1]["sources"] == [{"source_name": "A", "source_url": "u"}]


def test_exports(spark):
    e = table(spark, [event(0, at(0, "18:00"), at(0, "20:30"), title="A, b", description="x;y", venue_name="Bar", venue_address=""), event(1, at(0, "00:00"), all_day=True)])
    s = spark.createDataFrame([("e0", "A", "https://u")], "event_id string, source_name string, source_url string")
    rows = calendar.with_sources(e, s, []).orderBy("event_id").select(export.ical_content(F.lit("2026-06-01 00:00:00").cast("timestamp"), "P", "d").alias("ical"), export.share_text().alias("share"), export.calendar_link("https://c").alias("link")).collect()
    assert rows[0].ical.split("\r\n") == ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:P", "BEGIN:VEVENT", "UID:e0@d", "DTSTAMP:20260601T000000Z", "DTSTART:20260615T230000Z", "DTEND:20260616T013000Z", "SUMMARY:A\\, b", "DESCRIPTION:x\\;y", "LOCATION:Bar", "URL:https://u", "END:VEVENT", "END:VCALENDAR"]
    assert rows[0].share == "A, b\nMonday, June 15, 2026 · 6:00 PM – 8:30 PM\nBar\n\nx;y\n\nhttps://u"
    assert rows[0].link == "https://c?action=TEMPLATE&text=A%2C+b&dates=20260615T230000Z%2F20260616T013000Z&details=x%3By&location=Bar"
    assert "DTSTART;VALUE=DATE:20260615\r\nDTEND;VALUE=DATE:20260616\r\n" in rows[1].ical and "All day" in rows[1].share


@pytest.mark.parametrize("p,t,want", [([], [], (1, 1, 1)), (["x"], [], (0, 1, 0)), ([], ["x"], (1, 0, 0)), (["a", "b"], ["a", "c"], (0.5, 0.5, 0.5)), (["a"], ["b"], (0, 0, 0))])
def test_set_metrics(spark, p, t, want):
    df = spark.createDataFrame([(p, t)], "p array<string>, t array<string>")
    assert tuple(df.select(*tagging.set_metrics(F.col("p"), F.col("t"))).first()) == want


def test_parsers_batches_and_write_back(spark):
    r = spark.createDataFrame([(0, "0:Music\n1:Food & Drink,Nope\n2:\njunk")], "batch_id long, response string")
    assert {x.idx: x.tags for x in tagging.parse_compact(r, ["batch_id"]).collect()} == {"0": ["Music"], "1": ["Food & Drink"], "2": []}
    r = spark.createDataFrame([(0, '{"0":["Music","Nope"],"1":"x"}'), (1, "bad")], "batch_id long, response string")
    assert [(x.idx, x.tags) for x in tagging.parse_json(r, ["batch_id"]).collect()] == [("0", ["Music"])]
    e = table(spark, [event(i, at(0, "9:00"), description=("d" * 80 if i != 3 else "short")) for i in range(60)])
    some = tagging.untagged(e).withColumn("payload", tagging.payload(F.col("title"), F.col("description"), F.col("venue_name")))
    placed = tagging.numbered(some.where("payload is not null"), shards=1)
    req = tagging.batches(placed).orderBy("batch_id").collect()
    assert [len(x.request.split("\n")) for x in req] == [25, 25, 9]
    assert json.loads(req[0].request.split("\n")[1]) == {"id": "1", "title": "T1", "description": "d" * 80}
    answer = lambda texts: [None if "T5\"" in t else "\n".join(f"{json.loads(x)['id']}:Dance" for x in t.split("\n")[:2]) for t in texts]
    got = tagging.classify(tagging.batches(placed), answer)
    assert got.where("failed").count() == 1
    tags = tagging.parse_compact(got.where("not failed"), ["batch_id"])
    after = tagging.write_back(e, placed, tags)
    assert after.where("size(categories) = 1").count() == 4 and after.count() == 60
    assert tagging.tagging_stats(some, placed, tags).first().asDict() == {"tagged": 4, "skipped_no_description": 1, "candidates": 60, "batches": 3}


def test_cost(spark):
    u = spark.createDataFrame([("m", 10**6, 10**6, 10**6, 10**6)], "model string, input_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 1.0, 5.0)], "model string, input_price double, output_price double")
    assert tagging.usage_cost(u, prices, ["model"]).first().cost == pytest.approx(7.35)


def test_geocoding(spark):
    e = table(spark, [event(0, at(0, "9:00"), venue_name="Hall"), event(1, at(0, "9:00"), venue_name="hall "), event(2, at(0, "9:00"), venue_address="1 Main"), event(3, at(0, "9:00"), venue_name="Bad"), event(4, at(0, "9:00"), venue_name="", venue_address=""), event(5, at(0, "9:00"), venue_name="Old"), event(6, at(0, "9:00"))])
    cache = spark.createDataFrame([("old | town, st", None, None, None, "not_found", "g", None, 0)], VENUE_GEOCODES)
    gaz = spark.createDataFrame([("hall, town, st", "1.5", "2.5", "Hall"), ("bad, town, st", "x", "2", "Bad"), ("old, town, st", "3", "4", "Old")], "query string, lat string, lon string, display_name string")
    got, after, stats = geocode.backfill(e, cache, gaz, "2026-01-01 00:00:00", "town", "town, st")
    assert {r.event_id: r.latitude for r in got.collect()} == {"e0": 1.5, "e1": 1.5, "e2": None, "e3": None, "e4": None, "e5": None}
    assert stats.first().asDict() == {"hits": 2, "misses": 3, "skipped": 1, "errors": 1, "cleared": 0}
    assert {(r.lookup_key, r.status) for r in after.collect()} == {("hall | town, st", "success"), ("1 main, town, st", "not_found"), ("bad | town, st", "error"), ("old | town, st", "not_found")}
    got, _, stats = geocode.backfill(e, cache, gaz, "2026-01-01 00:00:00", "town", "town, st", force=True)
    assert stats.first().cleared == 1 and got.where("event_id = 'e5'").first().latitude == 3.0


def test_evaluation_counts_what_a_run_leaves_out(spark):
    truth = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["a", "b"]), (4, None)], "item long, tags array<string>")
    said = spark.createDataFrame([("x", 1, ["a"]), ("x", 3, ["a", "c"]), ("x", 9, ["a"]), ("y", 9, ["a"]), ("z", 2, ["a"]), ("z", 2, [])], "run string, item long, tags array<string>")
    got = {r.run: r for r in tagging.evaluate(truth, said, ["run"]).collect()}
    # x: 1 right, 3 half right, 2 and 4 rightly left out; y: nothing but the empty ones; z: 2 answered twice
    assert (got["x"].n_items, got["x"].avg_cats, got["x"].precision, got["x"].recall, got["x"].f1) == (4, 0.75, 0.875, 0.875, 0.875)
    assert (got["y"].n_items, got["y"].avg_cats, got["y"].precision, got["y"].recall, got["y"].f1) == (4, 0.0, 1.0, 0.5, 0.5)
    assert (got["z"].n_items, got["z"].precision, got["z"].recall, got["z"].f1) == (5, 0.8, 0.6, 0.4)
    assert tagging.evaluate(truth.where("false"), said, ["run"]).count() == 0


def test_collapse_keeps_each_category_once_in_the_order_of_rows(spark):
    rows = spark.createDataFrame([(2, "h", ["b", "a"]), (1, "h", ["c", "b", "c"]), (3, "h", None), (4, "g", []), (5, "g", None)], "seq long, canonical_hash string, categories array<string>")
    got = {r.canonical_hash: (r.seq, r.categories) for r in dedupe.collapse(rows).collect()}
    assert got == {"h": (1, ["c", "b", "a"]), "g": (4, [])}
