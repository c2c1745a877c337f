import datetime as dt
import hashlib
import random
from difflib import SequenceMatcher

import pytest

from fairgrid.functions.schemas import RAW
from fairgrid.operators import dedupe, merge
from fairgrid.sources import store
from fairgrid.streaming import incremental

START = dt.datetime(2026, 6, 15, 19)


def raw(title="Concert in the Park", url="https://example.com/event/1", venue="Garner Park", start=START, **more):
    row = {"seq": 0, "title": title, "start_at": start, "start_local_date": start.date(), "source_name": "s", "source_url": url, "description": None, "end_at": None, "venue_name": venue, "venue_address": None, "image_url": None, "categories": [], "all_day": False}
    return row | more


def deliver(spark, state, source, rows, run):
    events, sources = state or (store.empty(spark, "events"), store.empty(spark, "event_sources"))
    cols = [c.split()[0] for c in RAW.split(", ")]
    df = spark.createDataFrame([tuple((r | {"seq": i})[c] for c in cols) for i, r in enumerate(rows)], RAW)
    done = merge.ingest(df, events, sources, source, f"2026-06-0{run} 00:00:00")
    return (done.events, done.sources), tuple(merge.run_stats(done).first())


def both(state):
    return state[0].collect(), state[1].collect()


def test_first_insert_and_fill_nulls(spark):
    state, stats = deliver(spark, None, "A", [raw(description="Original description")], 1)
    assert stats == (1, 0, 0)
    state, stats = deliver(spark, state, "A", [raw(description="New attempt", venue_address="123 Main St")], 2)
    events, sources = both(state)
    assert stats == (0, 1, 0) and len(events) == len(sources) == 1
    assert (events[0].description, events[0].venue_address, events[0].status, sources[0].is_active) == ("Original description", "123 Main St", "active", True)
    _, stats = deliver(spark, state, "A", [raw(description="New attempt", venue_address="123 Main St")], 3)
    assert stats == (0, 0, 0)


def test_fuzzy_merge_across_sources(spark):
    state, _ = deliver(spark, None, "A", [raw(url="a")], 1)
    state, stats = deliver(spark, state, "B", [raw("Concert in the Parks", url="b")], 2)
    events, sources = both(state)
    assert stats == (0, 0, 0) and len(events) == 1 and {s.source_name for s in sources} == {"A", "B"}
    # one source goes, the other still lists it; then both are gone, and it comes back by hash
    state, stats = deliver(spark, state, "A", [], 3)
    assert stats == (0, 0, 1) and state[0].first().status == "active"
    state, stats = deliver(spark, state, "B", [], 4)
    assert stats == (0, 0, 1) and state[0].first().status == "removed"
    state, stats = deliver(spark, state, "B", [raw("Concert in the Parks", url="b")], 5)  # a removed event is no fuzzy candidate
    assert stats == (1, 0, 0)
    state, stats = deliver(spark, state, "A", [raw(url="a")], 6)
    assert stats == (0, 1, 0) and {e.status for e in state[0].collect()} == {"active"}


def test_same_hash_in_one_delivery(spark):
    state, stats = deliver(spark, None, "A", [raw("Volunteer", categories=["community"]), raw("volunteer ", categories=["food", "community"])], 1)
    events, sources = both(state)
    assert stats == (1, 0, 0) and len(sources) == 1 and events[0].categories == ["community", "food"]


def test_all_day_placeholder_is_superseded(spark):
    midnight = dt.datetime(2026, 6, 15, 5)
    state, _ = deliver(spark, None, "A", [raw(start=midnight, all_day=True, end_at=midnight + dt.timedelta(days=1))], 1)
    state, stats = deliver(spark, state, "A", [raw()], 2)
    e = state[0].first()
    assert stats == (0, 1, 0) and (e.all_day, e.start_at, e.end_at) == (False, START, None)


def test_anchors(spark):
    midnight = dt.datetime(2026, 6, 15, 5)
    state, _ = deliver(spark, None, "A", [raw("Art Walk", venue="Hall"), raw("Fair", venue=None, start=midnight, all_day=True)], 1)
    # no venue but a time: matches across venues; all-day without a venue never does
    state, stats = deliver(spark, state, "B", [raw("Art Walks", venue=None, url="w"), raw("Fairs", venue=None, start=midnight, all_day=True)], 2)
    assert stats[0] == 1
    # two raws of one delivery that link to one event: one listing, the first address
    state, stats = deliver(spark, state, "C", [raw("Art Walk!", venue="Hall", url="first"), raw("Art Walk?", venue="Hall", url="second")], 3)
    assert stats[0] == 0
    assert [s.source_url for s in state[1].where("source_name = 'C'").collect()] == ["first"]


def test_ratio_and_bound(spark):
    pairs = [("concert in the park", "concert in the parks"), ("abcd", "bcde"), ("tide", "diet"), ("diet", "tide"), ("a", "abcdefgh")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(dedupe.title_ratio("a", "b").alias("r"), dedupe.can_reach(df.a, df.b).alias("ok")).collect()
    assert [r.r for r in got] == [0.9743589743589743, 0.75, 0.25, 0.5, SequenceMatcher(None, "a", "abcdefgh").ratio()]
    assert [r.ok for r in got] == [True, True, True, True, False]


def sequential(rows, events):
    """Raws one after another, as the plan's docstring defines it."""
    known = [dict(e, founded=-1) for e in events]
    out = {}
    for seq, r in enumerate(rows):
        best, top = None, 0.0
        venue = (r["venue_name"] or "").strip().lower()
        for k in sorted(known, key=lambda k: k["key"]):
            if r["all_day"] and (not venue or k["start_at"].date() != r["start_local_date"]):
                continue
            if not r["all_day"] and k["start_at"] != r["start_at"]:
                continue
            if venue and (k["venue_name"] or "").strip().lower() != venue:
                continue
            ratio = SequenceMatcher(None, r["title"].lower(), k["title"].lower()).ratio()
            if ratio > top:
                best, top = k["key"], ratio
        if top >= 0.65:
            out[r["h"]] = (best, False)
        else:
            out[r["h"]] = (r["h"], True)
            known.append({"key": r["h"], **{c: r[c] for c in ("title", "start_at", "venue_name")}, "founded": seq})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_linking_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    title = lambda: " ".join(rng.choice(["jazz", "night", "open", "mic", "art", "walk", "fair"]) for _ in range(rng.randint(1, 4)))
    rows, seen = [], set()
    for _ in range(160):
        day = dt.datetime(2026, 6, rng.choice([15, 16]), 5)
        all_day = rng.random() < 0.3
        r = raw(title(), venue=rng.choice([None, "Hall", " hall", "Bar"]), start=day if all_day else day + dt.timedelta(hours=rng.choice([9, 14])), all_day=all_day)
        r["h"] = hashlib.sha256(f"{r['title']}|{r['start_local_date']}|{(r['venue_name'] or '').lower().strip()}".encode()).hexdigest()
        if r["h"] not in seen:
            seen.add(r["h"])
            rows.append(r)
    old, new = rows[:40], rows[40:]
    cols = [c.split()[0] for c in RAW.split(", ")]
    df = dedupe.with_hash(spark.createDataFrame([tuple((r | {"seq": i})[c] for c in cols) for i, r in enumerate(new)], RAW))
    known = [{"key": r["h"], **{c: r[c] for c in ("title", "start_at", "venue_name")}} for r in old]
    events = spark.createDataFrame([(k["key"], k["title"], k["start_at"], k["venue_name"], "active", False) for k in known], "event_id string, title string, start_at timestamp, venue_name string, status string, all_day boolean")
    got = {r.canonical_hash: (r.event_id, r.founds) for r in dedupe.link_misses(df, events).collect()}
    assert got == sequential(new, known)


def test_very_many_listings_at_one_start(spark):
    """100,000 listings without a venue at one instant: titles are compared once each, and the result is that of the loop."""
    rng = random.Random(4)
    words = ["jazz", "night", "open", "mic", "art", "walk", "fair", "yoga", "quiz", "film", "market", "brunch"]
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(220)})
    at = dt.datetime(2026, 6, 15, 19)
    rows = [(f"{i:08d}", rng.choice(titles), at, dt.date(2026, 6, 15), False, i, None) for i in range(100_000)]
    df = spark.createDataFrame(rows, "canonical_hash string, title string, start_at timestamp, start_local_date date, all_day boolean, seq long, venue_name string")
    events = spark.createDataFrame([("e1", titles[5], at, "Hall", "active", False), ("e0", titles[5], at, None, "active", False), ("e2", titles[9], at, None, "removed", False)], "event_id string, title string, start_at timestamp, venue_name string, status string, all_day boolean")
    ratio = {}

    def similar(a, b):
        if (a, b) not in ratio:
            ratio[a, b] = SequenceMatcher(None, a, b).ratio()
        return ratio[a, b]

    known, want = [("e0", titles[5]), ("e1", titles[5])], {}
    for h, t, *_ in rows:
        top, best = min(((-similar(t, u), k) for k, u in known), default=(0, None))
        want[h] = (best, False) if -top >= 0.65 else (h, True)
        if want[h][1]:
            known.append((h, t))
    got = {r.canonical_hash: (r.event_id, r.founds) for r in dedupe.link_misses(df, events).collect()}
    assert got == want and sum(f for _, f in want.values()) > 10


def plain_links(rows, events):
    """hash -> (event, founds) for misses and events (key, title, start, venue), one listing after another."""
    clean = lambda v: (v or "").strip().lower()
    known, want = {}, {}
    for key, title, start, venue in events:
        for b in (start, (start.date(), clean(venue))):
            known.setdefault(b, []).append((key, clean(title), start, clean(venue), -1))
    rows = sorted(rows, key=lambda r: r["seq"])
    # listings with a venue first: those without one are never candidates for them
    for r in [r for r in rows if clean(r["venue_name"])] + [r for r in rows if not clean(r["venue_name"])]:
        venue, when = clean(r["venue_name"]), r["start_local_date"] if r["all_day"] else r["start_at"].date()
        near = known.get((when, venue), []) if venue else [] if r["all_day"] else known.get(r["start_at"], [])
        near = [k for k in near if (r["all_day"] or k[2] == r["start_at"]) and k[4] < r["seq"]]
        top, best = min(((-SequenceMatcher(None, clean(r["title"]), k[1]).ratio(), k[0]) for k in near), default=(0, None))
        h = r["canonical_hash"]
        want[h] = (best, False) if -top >= 0.65 else (h, True)
        if want[h][1]:
            for b in dict.fromkeys([r["start_at"], (when, venue)] if venue else [r["start_at"]]):
                known.setdefault(b, []).append((h, clean(r["title"]), r["start_at"], venue, r["seq"]))
    return want


def test_registered_linking_against_a_plain_loop(spark):
    from fairgrid.plans import registry

    sf = "/root/testdata/sf0.01"
    m, events = registry.misses(spark, sf)
    there = [(e.event_id, e.title, e.start_at, e.venue_name) for e in events.where("status != 'removed'").collect()]
    got = {r.canonical_hash: (r.event_id, r.founds) for r in registry.QUERIES["j4_greedy_linking"](spark, sf).collect()}
    assert got == plain_links([r.asDict() for r in m.collect()], there)


def test_registered_fuzzy_ingest_against_a_plain_loop(spark):
    """Both deliveries of the query: collapsed, matched by hash, linked, merged and retired, one listing after another."""
    from fairgrid.plans import registry

    sf = "/root/testdata/sf0.01"
    events = {}
    for run in registry.runs(spark, sf):
        collapsed = {}
        for r in sorted((dedupe.with_hash(run).collect()), key=lambda r: r.seq):
            own = collapsed.setdefault(r.canonical_hash, r.asDict() | {"categories": []})
            own["categories"] += [c for c in dict.fromkeys(r.categories or []) if c not in own["categories"]]
        links = {h: (h, False) for h in collapsed if h in events}
        links |= plain_links([r for h, r in collapsed.items() if h not in links], [(h, e["title"], e["start_at"], e["venue_name"]) for h, e in events.items() if e["status"] != "removed"])
        events |= {h: r | {"status": "active", "founded": True} for h, r in collapsed.items() if links[h][1]}
        for h, r in sorted(collapsed.items(), key=lambda x: x[1]["seq"]):
            if links[h][1]:
                continue
            e = events[links[h][0]]
            if e["all_day"] and not r["all_day"]:
                e |= {"start_at": r["start_at"], "end_at": r["end_at"], "all_day": False}
            for f in ("description", "end_at", "venue_name", "venue_address", "image_url"):
                e[f] = r[f] if e[f] is None else e[f]
            e["categories"] = e["categories"] + [c for c in r["categories"] if c not in e["categories"]]
            e["status"] = "active"
        seen = {e for e, _ in links.values()}
        for h, e in events.items():
            if h not in seen:
                e["status"] = "removed"
    want = sorted((h, e["title"], str(e["start_at"]), e["status"], ",".join(e["categories"])) for h, e in events.items())
    assert sorted((r.event_id, r.title, r.start_at, r.status, r.categories) for r in registry.QUERIES["m_ingest_fuzzy"](spark, sf).collect()) == want


def test_stream_of_deliveries(spark, tmp_path):
    import json

    landing = tmp_path / "in"
    landing.mkdir()
    for i, rows in enumerate([[raw(url="a")], [raw("Concert in the Parks", url="b"), raw("Other", url="c")]]):
        lines = [json.dumps(r | {"seq": n, "source_name": f"S{i}", "delivery": str(i), "start_at": "2026-06-15T19:00:00Z", "start_local_date": "2026-06-15"}) for n, r in enumerate(rows)]
        (landing / f"{i}.json").write_text("\n".join(lines))
    q = incremental.stream_deliveries(spark, str(landing), str(tmp_path / "store"), str(tmp_path / "cp"), lambda b: f"2026-06-0{b + 1} 00:00:00")
    q.awaitTermination(120)
    versions = sorted(p.name for p in (tmp_path / "store").iterdir() if p.name[0] != "_")
    assert len(versions) == 2 and versions[-1] == incremental.newest(spark, str(tmp_path / "store"))
    events = store.read(spark, str(tmp_path / "store"), versions[-1], "events").collect()
    sources = store.read(spark, str(tmp_path / "store"), versions[-1], "event_sources").collect()
    assert len(events) == 2 and len(sources) == 3


def test_no_delivery_is_lost(spark, tmp_path, monkeypatch):
    """Equal run times, death between the two writes, and starts without arguments."""
    import json

    landing, root, cp = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    landing.mkdir()

    def put(name, *titles):
        lines = [json.dumps(raw(t, url=t) | {"seq": n, "source_name": "S", "delivery": name, "start_at": "2026-06-15T19:00:00Z", "start_local_date": "2026-06-15"}) for n, t in enumerate(titles)]
        (landing / f"{name}.json").write_text("\n".join(lines))

    def run(files=1, checkpoint=cp):
        q = incremental.stream_deliveries(spark, str(landing), root, checkpoint, lambda b: "2026-06-01 00:00:00", threshold=None, files=files)
        try:
            q.awaitTermination(120)
        except Exception:
            return False
        return True

    titles = lambda: {r.title for r in store.read(spark, root, incremental.newest(spark, root), "events").collect()}
    put("1", "One")
    put("2", "Two")
    assert run(files=None) and titles() == {"One", "Two"}
    write, died = store.write, []

    def dies(df, r, v, name, **how):
        if name == "event_sources" and not died:
            died.append(v)
            raise RuntimeError("lost")
        write(df, r, v, name, **how)

    monkeypatch.setattr(store, "write", dies)
    put("3", "Three")
    assert not run() and died and titles() == {"One", "Two"}
    assert run() and titles() == {"One", "Two", "Three"}
    put("4", "Four")
    assert run() and titles() == {"One", "Two", "Three", "Four"}
    assert run(checkpoint=cp + "2") and len(titles()) == 4  # another stream over the same files goes on from the newest version
    assert incremental.published(spark, root).count() == 8


def test_first_occurrence_of_a_document_wins(spark):
    from fairgrid.operators import dedupe
    from fairgrid.sources import json_docs

    doc = "('t', 'Friday 6pm-7pm, Friday 11am-12pm', '2026-05-08T06:00:00Z')"
    docs = spark.sql(f"select 1L seq, * from values {doc} as v(title, times, startDate)")
    more = {"description": "string", "teaser": "string", "location": "string", "address1": "string", "city": "string", "state": "string", "zip": "string", "endDate": "string", "nextDate": "string", "dates": "struct<eventDate:string>", "startTime": "string", "endTime": "string", "categories": "array<struct<catName:string>>", "media_raw": "array<struct<mediaurl:string>>", "absoluteUrl": "string", "url": "string"}
    docs = docs.selectExpr("*", *[f"cast(null as {t}) {c}" for c, t in more.items()]).withColumn("endDate", docs["startDate"])
    rows = json_docs.raw_events(docs, "S", "https://e.com")
    assert rows.count() == 2
    assert {str(r.start_at)[11:16] for r in dedupe.collapse(rows.repartition(2, "start_at")).collect()} == {"23:00"}
