import datetime as dt
import random

from pyspark.sql import functions as F

from fairgrid.operators import calendar, geocode, search


def test_search_finds_what_a_scan_finds(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcÀéß日🙂 X") for _ in range(rng.randrange(0, 40))) for _ in range(120)] + [None, "", "The Bar", "the bar", "İstanbul", "ab"]
    terms = [rng.choice([n for n in names if n])[a : a + k] for a in range(12) for k in (1, 2, 3, 4, 7, 30)] + ["zz", "zzz", "AB", "", None, "the", "abq"]
    rows = spark.createDataFrame([(n,) for n in names], "venue string")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted((r.term, r.name) for r in search.search(search.index(rows, "venue"), rows, "venue", asked).collect())
    distinct = rows.where("venue is not null").distinct()
    want = sorted((t, r.venue) for t in {t for t in terms if t is not None} for r in distinct.where(F.contains(F.lower("venue"), F.lower(F.lit(t)))).collect())
    assert got == want and len(got) > 300


def test_counts_of_days_without_days_of_events(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        start = dt.datetime(2026, 6, 1) + dt.timedelta(hours=rng.randrange(2000))
        end = rng.choice([None, start + dt.timedelta(hours=rng.randrange(-40, 900))])
        rows.append((i, start, end, rng.choice(["active", "active", "removed"]), rng.choice([True, False, None])))
    rows.append((900, dt.datetime(2027, 1, 5), None, "active", True))  # days without any event in between
    df = spark.createDataFrame(rows, "event_id int, start_at timestamp, end_at timestamp, status string, flag boolean")
    want = calendar.event_days(df).groupBy("day").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))
    got = calendar.day_counts(df, {"flagged": F.col("flag")})
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert calendar.day_counts(df.limit(0)).collect() == []


def test_a_box_reads_few_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"{i:05d}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(4000)] + [("x", None, 3.0), ("y", 90.0, 180.0), ("z", -90.0, -180.0)]
    df = spark.createDataFrame(rows, "event_id string, latitude double, longitude double")
    geocode.write_by_place(df.repartition(40), str(tmp_path / "p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        geocode.write_by_place(df, str(tmp_path / "q"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    box = (-10.0, 52.0, 21.0, 40.0)
    out = geocode.read_box(spark, str(tmp_path / "q"), box)
    assert sorted(r.event_id for r in out.collect()) == sorted(i for i, lat, lon in rows if lat is not None and -10 <= lon <= 21 and 40 <= lat <= 52)
    plan = out._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    assert plan.metrics().apply("numOutputRows").value() < 1000  # rows of files whose statistics meet the box
