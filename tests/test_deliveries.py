import datetime as dt
import random

import pytest

from fairgrid.functions.schemas import RAW
from fairgrid.operators import deliveries, merge
from fairgrid.sources import store

COLUMNS = [c.split()[0] for c in RAW.split(", ")]
T0 = dt.datetime(2026, 6, 15, 19)


def listing(rng, source):
    n = rng.randrange(14)
    text = lambda: rng.choice([None, f"t{rng.randrange(5)}"])
    all_day = rng.random() < 0.5
    start = T0 + dt.timedelta(days=n)
    return {"title": f"Event {n}", "start_at": start.replace(hour=5) if all_day else start, "start_local_date": start.date(), "source_name": source, "source_url": f"{source}{rng.randrange(99)}", "description": text(), "end_at": rng.choice([None, start + dt.timedelta(hours=rng.randrange(1, 9))]),
            "venue_name": "Hall", "venue_address": text(), "image_url": text(), "categories": rng.choice([None, [], ["a"], ["b", "a"], ["c"]]), "all_day": all_day}


def made(seed, n):
    """Deliveries (source, run time, rows); run times rise but may stand still."""
    rng, out, hours = random.Random(seed), [], 0
    for _ in range(n):
        source = rng.choice(["A", "B", "C"])
        hours += rng.choice([0, 1, 1, 2])
        rows = [listing(rng, source) | {"seq": i} for i in range(rng.choice([0, 1, 3, 6]))]
        out.append((source, str(dt.datetime(2026, 6, 1) + dt.timedelta(hours=hours)), rows))
    return out


def loop(given):
    """Each delivery, each of its events, by the rules of ingesting one delivery."""
    events, sources = {}, {}
    for source, run, rows in given:
        collapsed = {}
        for r in rows:
            h = r["title"]
            if h not in collapsed:
                collapsed[h] = dict(r, categories=list(dict.fromkeys(r["categories"] or [])))
            else:
                collapsed[h]["categories"] += [c for c in dict.fromkeys(r["categories"] or []) if c not in collapsed[h]["categories"]]
        for h, r in collapsed.items():
            if h not in events:
                events[h] = {f: r[f] for f in ("description", "start_at", "end_at", "venue_address", "image_url", "all_day")} | {"categories": list(r["categories"]), "status": "active", "created_at": run, "updated_at": run}
            else:
                e = events[h]
                was = dict(e, categories=list(e["categories"]))
                upgraded = e["all_day"] and not r["all_day"]
                if upgraded:
                    e |= {"start_at": r["start_at"], "end_at": r["end_at"], "all_day": False}
                for f in ("description", "end_at", "venue_address", "image_url"):
                    e[f] = r[f] if e[f] is None else e[f]
                e["categories"] += [c for c in r["categories"] if c not in e["categories"]]
                e["status"] = "active"
                if upgraded or e != was:
                    e["updated_at"] = run
            s = sources.setdefault((h, source), {"created_at": run})
            s |= {"source_url": r["source_url"], "last_seen_at": run, "is_active": True}
        for (_, name), s in sources.items():
            if name == source and s["last_seen_at"] < run and s["is_active"]:
                s["is_active"] = False
        for h, e in events.items():
            if e["status"] == "active" and not any(s["is_active"] for (k, _), s in sources.items() if k == h):
                e["status"] = "removed"
    return events, sources


def frames(spark, given):
    rows = [(d, *(r[c] for c in COLUMNS)) for d, (_, _, own) in enumerate(given) for r in own]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, f"d int, {RAW}").repartition(4), [(s, run) for s, run, _ in given]


def tables(m):
    events = {r.title: r for r in m.events.collect()}
    titles = {r.event_id: t for t, r in events.items()}
    return events, {(titles[r.event_id], r.source_name): r for r in m.sources.collect()}


def same(m, want):
    events, sources = tables(m)
    assert set(events) == set(want[0]) and set(sources) == set(want[1])
    for h, e in want[0].items():
        got = {k: events[h][k] for k in e} | {"created_at": str(events[h].created_at), "updated_at": str(events[h].updated_at)}
        assert got == e, h
    for k, s in want[1].items():
        r = sources[k]
        assert {"created_at": str(r.created_at), "source_url": r.source_url, "last_seen_at": str(r.last_seen_at), "is_active": r.is_active} == s, k


@pytest.mark.parametrize("seed, n", [(1, 200), (2, 30), (3, 30), (4, 7)])
def test_many_at_once_as_one_after_another(spark, seed, n):
    given = made(seed, n)
    raws, named = frames(spark, given)
    same(deliveries.ingest_many(raws, store.empty(spark, "events"), store.empty(spark, "event_sources"), named), loop(given))


def test_batches_go_on_from_each_other(spark):
    given = made(9, 24)
    events, sources = store.empty(spark, "events"), store.empty(spark, "event_sources")
    for part in (given[:9], given[9:10], given[10:]):
        raws, named = frames(spark, part)
        m = deliveries.ingest_many(raws, events, sources, named)
        events, sources = (spark.createDataFrame(df.collect(), df.schema) for df in (m.events, m.sources))
    same(m, loop(given))


def test_as_single_ingests(spark):
    given = made(5, 4)
    raws, named = frames(spark, given)
    m = deliveries.ingest_many(raws, store.empty(spark, "events"), store.empty(spark, "event_sources"), named)
    events, sources = store.empty(spark, "events"), store.empty(spark, "event_sources")
    for d, (source, run, _) in enumerate(given):
        one = merge.ingest(raws.where(raws.d == d).drop("d"), events, sources, source, run, None)
        events, sources = (spark.createDataFrame(df.collect(), df.schema) for df in (one.events, one.sources))
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: (r["event_id"], r.get("source_name", "")))
    plain = lambda rs: [r | {"categories": r.get("categories") or []} for r in rs]
    assert plain(rows(m.events)) == plain(rows(events)) and rows(m.sources.select(*sources.columns)) == rows(sources)


def test_a_stream_takes_a_batch_in_one_pass(spark, tmp_path):
    import json

    from fairgrid.streaming import incremental

    (tmp_path / "in").mkdir()
    given = [(s, "2026-06-01 00:00:00", rows) for s, _, rows in made(6, 12) if rows]
    for d, (source, _, rows) in enumerate(given):
        lines = [json.dumps({k: str(v) if isinstance(v, dt.date) else v for k, v in r.items()} | {"delivery": f"{d:03d}"}) for r in rows]
        (tmp_path / f"in/{d:03d}.json").write_text("\n".join(lines))
    root = str(tmp_path / "store")
    incremental.stream_deliveries(spark, str(tmp_path / "in"), root, str(tmp_path / "cp"), lambda b: "2026-06-01 00:00:00", threshold=None, files=None, at_once=True).awaitTermination(200)
    assert incremental.published(spark, root).count() == 1
    version = incremental.newest(spark, root)
    same(merge.Merged(store.read(spark, root, version, "events"), store.read(spark, root, version, "event_sources"), None, None), loop(given))
