import datetime as dt
import random

import pytest

from fairgrid.operators import dedupe, merge

EVENT = "event_id string, title string, description string, start_at timestamp, end_at timestamp, venue_name string, venue_address string, categories array<string>, image_url string, all_day boolean, status string"
RAW = "event_id string, founds boolean, seq long, place int, start_at timestamp, end_at timestamp, all_day boolean, description string, venue_name string, venue_address string, image_url string, categories array<string>, source_url string"
T0 = dt.datetime(2026, 6, 1)


def loop(event, raws):
    """Raws one after another into an event."""
    e, changed = dict(event, categories=list(event["categories"] or [])), False
    for r in raws:
        was = dict(e, categories=list(e["categories"]))
        if e["all_day"] and not r["all_day"]:
            e |= {"start_at": r["start_at"], "end_at": r["end_at"], "all_day": False}
            changed = True
        for f in ("description", "end_at", "venue_name", "venue_address", "image_url"):
            if e[f] is None:
                e[f] = r[f]
        e["categories"] += [c for c in dict.fromkeys(r["categories"] or []) if c not in e["categories"]]
        e["status"] = "active"
        changed |= e != was
    return e, changed


def some_raw(rng, event_id, seq, place):
    hours = lambda: T0 + dt.timedelta(hours=rng.randrange(200))
    text = lambda: rng.choice([None, None, f"t{rng.randrange(9)}"])
    return {"event_id": event_id, "founds": False, "seq": seq, "place": place, "start_at": hours(), "end_at": rng.choice([None, hours()]), "all_day": rng.random() < 0.6, "description": text(), "venue_name": text(), "venue_address": text(), "image_url": text(),
            "categories": rng.choice([None, [], ["a"], ["b", "a"], ["c", "c", "d"]]), "source_url": f"u{seq}-{place}"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_raws_one_after_another(spark, seed):
    rng = random.Random(seed)
    events, raws, want = [], [], {}
    for n in range(60):
        e = some_raw(rng, f"e{n}", 0, 0)
        e = {c.split()[0]: e.get(c.split()[0]) for c in EVENT.split(", ")} | {"title": "x", "status": rng.choice(["active", "removed"])}
        own = sorted([some_raw(rng, e["event_id"], rng.randrange(4), 0) for _ in range(rng.randrange(7))], key=lambda r: r["seq"])
        for i, r in enumerate(own):  # occurrences of one document share its seq
            r["place"] = i
        events.append(e)
        raws += own
        want[e["event_id"]] = loop(e, own)
    rng.shuffle(raws)
    cols = [c.split()[0] for c in RAW.split(", ")]
    attached = spark.createDataFrame([tuple(r[c] for c in cols) for r in raws], RAW).repartition(5)
    ev = spark.createDataFrame([tuple(e[c.split()[0]] for c in EVENT.split(", ")) for e in events], EVENT)
    for r in merge.merge_fields(ev, attached).collect():
        e, changed = want[r.event_id]
        got = r.asDict()
        if not got["categories"]:
            got["categories"] = []
        assert {k: got[k] for k in e} == e, r.event_id
        assert bool(r.changed) == (changed or False), r.event_id


def test_an_event_with_very_many_raws(spark):
    n = 400_000
    raws = spark.range(n).selectExpr(
        "'e' as event_id", "false as founds", "id as seq", "0 as place", "timestamp'2026-06-01 10:00:00' + make_interval(0,0,0,0,0,0,id) as start_at", f"if(id = {n - 1}, timestamp'2026-06-02 00:00:00', null) as end_at",
        "id < 300000 as all_day", f"if(id = {n - 2}, 'late', null) as description", "cast(null as string) as venue_name", "cast(null as string) as venue_address", "cast(null as string) as image_url", "array(concat('c', cast(id % 3 as string))) as categories", "'u' as source_url",
    )
    ev = spark.createDataFrame([("e", "x", None, T0, None, None, None, ["c1"], None, True, "removed")], EVENT)
    out = merge.merge_fields(ev, raws)
    r = out.first()
    assert (r.description, str(r.end_at), r.categories, r.status, r.all_day, r.changed) == ("late", "2026-06-02 00:00:00", ["c1", "c0", "c2"], "active", False, True)
    assert r.start_at == dt.datetime(2026, 6, 1, 10) + dt.timedelta(seconds=300_000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1  # of the distinct categories


def test_collapse_keeps_the_place(spark):
    rows = spark.createDataFrame([("h", 1, 2, ["b"]), ("h", 1, 0, ["a"]), ("k", 1, 1, None)], "canonical_hash string, seq long, place int, categories array<string>")
    assert sorted((r.canonical_hash, r.seq, r.place, r.categories) for r in dedupe.collapse(rows).collect()) == [("h", 1, 0, ["a", "b"]), ("k", 1, 1, [])]
