import datetime as dt
import random

import pytest
from dateutil import rrule
from dateutil.tz import gettz

from fairgrid.sources import calendar_text as C

HOME = gettz("America/Chicago")
UTC = dt.timezone.utc


def rows_of(spark, tmp_path, *files):
    for n, body in enumerate(files):
        (tmp_path / f"{n:02d}.ics").write_text("\r\n".join(body.strip("\n").split("\n")) + "\r\n")
    return C.rows(C.read(spark, str(tmp_path))).orderBy("seq").collect()


def event(*lines):
    return "\n".join(["BEGIN:VEVENT", *lines, "END:VEVENT"])


def test_zones_of_times(spark, tmp_path):
    own = """BEGIN:VCALENDAR
BEGIN:VTIMEZONE
TZID:Eastern by hand
BEGIN:STANDARD
DTSTART:20071104T020000
TZOFFSETFROM:-0400
TZOFFSETTO:-0500
RRULE:FREQ=YEARLY;BYMONTH=11;BYDAY=1SU
END:STANDARD
BEGIN:DAYLIGHT
DTSTART:20070311T020000
TZOFFSETFROM:-0500
TZOFFSETTO:-0400
RRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=2SU
END:DAYLIGHT
END:VTIMEZONE
"""
    body = own + "\n".join(
        event(f"SUMMARY:{n}", line)
        for n, line in enumerate(
            ["DTSTART;TZID=America/New_York:20240101T190000", 'DTSTART;TZID="Europe/Berlin":20240701T190000', "DTSTART;X-A=1;TZID=/maker.org/2019/Asia/Tokyo:20240101T190000", "DTSTART;TZID=Eastern by hand:20240101T190000",
             "DTSTART;TZID=Eastern by hand:20240701T190000", "DTSTART:20240101T190000", "DTSTART:20240101T190000Z", "DTSTART;VALUE=DATE:20240101", "DTSTART;TZID=Nowhere:20240101T190000",
             "DTSTART;TZID=Eastern by hand:20240310T015959", "DTSTART;TZID=Eastern by hand:20240310T030000", "DTSTART;TZID=Eastern by hand:20051104T010000"]
        )
    )
    got = [str(r.dtstart) for r in rows_of(spark, tmp_path, body)]
    assert got == ["2024-01-02 00:00:00", "2024-07-01 17:00:00", "2024-01-01 10:00:00", "2024-01-02 00:00:00", "2024-07-01 23:00:00", "2024-01-02 01:00:00", "2024-01-01 19:00:00", "2024-01-01 06:00:00", "2024-01-02 01:00:00",
                   "2024-03-10 06:59:59", "2024-03-10 07:00:00", "2005-11-04 06:00:00"]


def test_components_and_properties(spark, tmp_path):
    body = event("BEGIN:VALARM", "DESCRIPTION:ring", "BEGIN:X-INNER", "SUMMARY:inner", "END:X-INNER", "TRIGGER:-PT5M", "END:VALARM", "SUMMARY;LANGUAGE=en:A\\, b: c", "DESCRIPTION:first", " -second\\nthird BEGIN:VEVENT", "LOCATION:", "DTSTART:20240101T190000Z", "DURATION:PT1H30M")
    other = event("summary:low", "DTSTART;TZID=America/Chicago:20240309T190000", "DURATION:P1D") + "\n" + event("SUMMARY:long", "DTSTART:20240101T000000Z", "DURATION:-P1W") + "\n" + event("SUMMARY:none", "DTSTART:junk", "DTEND:20240101T000000Z")
    got = rows_of(spark, tmp_path, "BEGIN:VCALENDAR\n" + body, other + "\nEND:VCALENDAR", "BEGIN:VCALENDAR\nEND:VCALENDAR", "BEGIN:VEVENT\nSUMMARY:cut")
    assert [(r.summary, r.description, r.location, str(r.dtstart), str(r.dtend)) for r in got] == [
        ("A, b: c", "first-second\nthird BEGIN:VEVENT", None, "2024-01-01 19:00:00", "2024-01-01 20:30:00"),
        ("low", None, None, "2024-03-10 01:00:00", "2024-03-11 00:00:00"),  # a day by the clock, over the change
        ("long", None, None, "2024-01-01 00:00:00", "2023-12-25 00:00:00"),
        ("none", None, None, "None", "2024-01-01 00:00:00"),
    ]


def expanded(spark, tmp_path, start, end, *events):
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\n" + "\n".join(events) + "\nEND:VCALENDAR\n")
    out = C.expand(C.rows(C.read(spark, str(tmp_path))), start, end)
    return sorted((r.summary, str(r.start_at)) for r in out.collect())


def test_sets(spark, tmp_path):
    chicago = "DTSTART;TZID=America/Chicago:20240101T190000"
    series = event("UID:a", "SUMMARY:a", chicago, "RRULE:FREQ=DAILY;UNTIL=20240104T000000Z")
    moved = event("UID:b", "SUMMARY:b", chicago, "RRULE:FREQ=DAILY;COUNT=4", "EXDATE;TZID=America/Chicago:20240102T190000", "RDATE:20240110T010000Z,20240102T010000Z", "RDATE;VALUE=DATE:20240112")
    instead = event("UID:b", "SUMMARY:b moved", "RECURRENCE-ID;TZID=America/Chicago:20240103T190000", "DTSTART;TZID=America/Chicago:20240103T210000")
    again = event("UID:b", "SUMMARY:b moved again", "SEQUENCE:2", "RECURRENCE-ID:20240104T010000Z", "DTSTART;TZID=America/Chicago:20240103T220000")
    sunday = event("UID:c", "SUMMARY:c", "DTSTART:20240102T120000Z", "RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=SU,TU;WKST=SU;COUNT=4")
    monday = event("UID:d", "SUMMARY:d", "DTSTART:20240102T120000Z", "RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=SU,TU;COUNT=4")
    york = event("UID:e", "SUMMARY:e", "DTSTART;TZID=America/New_York:20240309T190000", "RRULE:FREQ=DAILY;COUNT=2")
    hourly = event("UID:f", "SUMMARY:f", "DTSTART:20240102T120000Z", "RRULE:FREQ=HOURLY")
    got = expanded(spark, tmp_path, "2024-01-01", "2024-04-01", series, moved, instead, again, sunday, monday, york, hourly)
    assert [t for s, t in got if s == "a"] == ["2024-01-02 01:00:00", "2024-01-03 01:00:00"]
    assert [(s, t) for s, t in got if s[0] == "b"] == [("b", "2024-01-02 01:00:00"), ("b", "2024-01-05 01:00:00"), ("b", "2024-01-10 01:00:00"), ("b", "2024-01-13 01:00:00"), ("b moved again", "2024-01-04 04:00:00")]
    assert [t[5:10] for s, t in got if s == "c"] == ["01-02", "01-14", "01-16", "01-28"]
    assert [t[5:10] for s, t in got if s == "d"] == ["01-02", "01-07", "01-16", "01-21"]
    assert [t for s, t in got if s == "e"] == ["2024-03-10 00:00:00", "2024-03-10 23:00:00"]
    assert [t for s, t in got if s == "f"] == ["2024-01-02 12:00:00"]


def random_rule(rng):
    pick = lambda xs, k: ",".join(map(str, rng.sample(xs, rng.randrange(1, k + 1))))
    freq = rng.choice(C.FREQUENCIES)
    parts = [f"FREQ={freq}", f"INTERVAL={rng.choice([1, 1, 2, 3, 5])}"]
    days = list(C.DAYS)
    if freq in ("MONTHLY", "YEARLY") and rng.random() < 0.5:
        days = [f"{n}{d}" for d in C.DAYS for n in (1, 2, -1, 5, -2)]  # the other expander takes no mix of both kinds
    if rng.random() < 0.5:
        parts.append("BYDAY=" + pick(days, 3))
    if freq != "WEEKLY" and rng.random() < 0.25:
        parts.append("BYMONTHDAY=" + pick([1, 13, 15, 29, 31, -1, -3], 3))
    if rng.random() < 0.25:
        parts.append("BYMONTH=" + pick(list(range(1, 13)), 4))
    if freq == "YEARLY" and rng.random() < 0.2 and "BYDAY" not in "".join(parts):
        parts.append("BYYEARDAY=" + pick([1, 60, 100, 200, 366, -1, -50], 3))
    if freq == "YEARLY" and rng.random() < 0.2 and not any(d[0] in "-0123456789" for d in "".join(p[6:] for p in parts if p.startswith("BYDAY")).split(",") if d):
        parts.append("BYWEEKNO=" + pick([1, 2, 20, 52, 53, -1], 2))
    if rng.random() < 0.15:
        parts.append("BYHOUR=" + pick([8, 12, 19], 2))
    if rng.random() < 0.25 and any(p.startswith("BY") for p in parts):
        parts.append("BYSETPOS=" + pick([1, 2, -1], 2))
    if rng.random() < 0.3:
        parts.append("WKST=" + rng.choice(C.DAYS))
    end = rng.random()
    if end < 0.35:
        parts.append(f"COUNT={rng.randrange(1, 40)}")
    elif end < 0.6:
        parts.append("UNTIL=" + rng.choice(["20250310", "20250310T030000Z", "20240601T120000"]))
    return ";".join(parts)


def test_against_a_plain_expander(spark):
    """Random rules of every part and frequency against an expander that goes from one date to the next."""
    rng, rows, want = random.Random(11), [], set()
    lo, hi = dt.datetime(2025, 1, 20, tzinfo=HOME), dt.datetime(2025, 5, 2, tzinfo=HOME)
    for seq in range(400):
        rule = random_rule(rng)
        wall = dt.datetime(rng.choice([2019, 2023, 2024, 2025]), rng.randrange(1, 13), rng.choice([1, 7, 15, 28]), rng.choice([9, 19]), 30)
        start = wall.replace(tzinfo=HOME).astimezone(UTC)
        naive, until = rule, None
        for p in rule.split(";"):
            if p.startswith("UNTIL="):
                naive, u = rule.replace(";" + p, ""), p[6:]
                until = dt.datetime.strptime(u[:15].rstrip("Z") if "T" in u else u + "T235959", "%Y%m%dT%H%M%S")
                until = until.replace(tzinfo=UTC if u.endswith("Z") else HOME)
        for at in rrule.rrulestr(naive, dtstart=wall).between(wall - dt.timedelta(1), hi.replace(tzinfo=None) + dt.timedelta(2), inc=True):
            instant = at.replace(tzinfo=HOME)
            if lo <= instant < hi and (until is None or instant <= until):
                want.add((seq, instant.astimezone(UTC).replace(tzinfo=None)))
        rows.append((seq, str(seq), start.replace(tzinfo=None), None, None, None, rule, []))
    df = spark.createDataFrame(rows, "seq long, summary string, dtstart timestamp, dtend timestamp, location string, description string, rrule string, exdate array<string>").repartition(4)
    assert C.unknown_rules(df).count() == 0
    got = [(r.seq, r.start_at) for r in C.expand(df, "2025-01-20", "2025-05-02").collect()]
    assert len(got) == len(set(got))
    wrong = {s for s, _ in set(got) ^ want}
    assert not wrong, [(rows[s][6], str(rows[s][2]), sorted(str(t) for q, t in set(got) - want if q == s)[:3], sorted(str(t) for q, t in want - set(got) if q == s)[:3]) for s in sorted(wrong)[:6]]
    assert len(want) > 1500


def test_order_of_files(spark, tmp_path):
    from fairgrid.sources import feeds, json_docs

    (tmp_path / "x").mkdir()
    (tmp_path / "j").mkdir()
    sizes = [3, 4000, 1, 0, 60]
    for n, size in enumerate(sizes):
        items = "".join(f"<item><title>{n}-{i}</title><link>l</link></item>\n" for i in range(size))
        (tmp_path / f"x/{n}.xml").write_text(f"<rss><channel>\n{items}</channel></rss>")
        (tmp_path / f"j/{n}.json").write_text("".join(f'{{"title": "{n}-{i}"}}\n' for i in range(size)))
    want = [f"{n}-{i}" for n, size in enumerate(sizes) for i in range(size)]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for df in (feeds.read_rss(spark, str(tmp_path / "x")), json_docs.read(spark, str(tmp_path / "j"))):
            assert [r.title for r in df.orderBy("seq").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_dense_numbers(spark, n):
    from fairgrid.operators.numbering import dense

    out = dense(spark.range(n).selectExpr("(id * 7919) % 10007 as x"), ["x"], "n").orderBy("x").collect()
    assert [r.n for r in out] == list(range(n))


def test_own_lines_against_a_plain_loop(spark):
    """Random begins and ends, also without the other, against a count of depth from line to line."""
    rng = random.Random(3)
    texts = [[rng.choice(["BEGIN:A", "begin:B", "END:A", "End:C", "X:1", "SUMMARY:BEGIN:A", " folded", "", "BEGINS:x"]) for _ in range(rng.randrange(0, 25))] for _ in range(400)]
    df = spark.createDataFrame([(n, "\n".join(t)) for n, t in enumerate(texts)], "n int, t string")
    got = {r.n: r.own for r in df.select("n", C._own(C._lines(C.F.col("t"))).alias("own")).collect()}
    for n, t in enumerate(texts):
        depth, own = 0, []
        for x in "\n".join(t).replace("\n ", "").split("\n"):
            begin, end = x.upper().startswith("BEGIN:"), x.upper().startswith("END:")
            if depth == 0 and not begin and not end and x:
                own.append(x)
            depth = max(depth + begin - end, 0)
        assert [x for x in got[n].split("\n") if x] == own, t


def zone(name, offset):
    return f"BEGIN:VTIMEZONE\nTZID:{name}\nBEGIN:STANDARD\nDTSTART:19700101T000000\nTZOFFSETFROM:{offset}\nTZOFFSETTO:{offset}\nEND:STANDARD\nEND:VTIMEZONE\n"


def test_events_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    """A file's events are taken by as many tasks as it has splits, whatever zones it defines and how often; the same rows where zones and splits are too many to be sent along."""
    from fairgrid.functions import lineage

    one = lambda n: zone("A", "-0330") + zone("A", "+0900") + event(f"UID:{n}", f"DTSTART;TZID={['A', 'Nowhere', 'Europe/Berlin'][n % 3]}:20240101T120000", "DURATION:PT1H")
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\n" + "\n".join(map(one, range(300))) + "\nEND:VCALENDAR\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        chunks = C.read(spark, str(tmp_path))
        assert C.zones(chunks).count() == 1
        tasks = C.rows(chunks).select("uid", C.F.spark_partition_id().alias("task")).collect()
        assert len({r.task for r in tasks}) >= 5 and max(sum(r.task == t for r in tasks) for t in {r.task for r in tasks}) < 150
        sent = C.rows(chunks).orderBy("seq").collect()
        monkeypatch.setattr(lineage, "BROADCAST_BYTES", -1)
        assert C.rows(C.read(spark, str(tmp_path))).orderBy("seq").collect() == sent
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [r.uid for r in sent] == [str(n) for n in range(300)]
    assert {r.uid[-1:]: str(r.dtend) for r in sent[:3]} == {"0": "2024-01-01 16:30:00", "1": "2024-01-01 19:00:00", "2": "2024-01-01 12:00:00"}
