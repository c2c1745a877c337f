import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["day", "hour", "n"] and rows.count() % 24 == 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 50


@pytest.mark.parametrize("name", ["a4_hour_histogram", "m1_m5_j7_merge_exact", "j8_a16_f2_resolve_urls", "a10_geocode_stats", "s4_recurrence", "a12_a13_j16_evaluate", "w4_batches", "a11_tagging_stats", "j15_write_back", "s5_page_text", "a1_w1_collapse"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    done = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in done.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str)
    assert sorted(df.columns) == sorted(names)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want] or got == want


def test_best_matches_against_every_pair(spark):
    """The registered query against a plain loop over all listings of a run and all events before it."""
    from difflib import SequenceMatcher

    from fairgrid.plans import registry

    sf = "/root/testdata/sf0.01"
    m, known = registry.misses(spark, sf)
    clean = lambda s: (s or "").lower().strip()
    by_start, by_day = {}, {}
    for e in known.where("status != 'removed'").collect():
        by_start.setdefault(e.start_at, []).append(e)
        by_day.setdefault(e.start_at.date(), []).append(e)
    want = {}
    for r in m.collect():
        venue = clean(r.venue_name)
        near = by_day.get(r.start_local_date, []) if r.all_day and venue else [] if r.all_day else by_start.get(r.start_at, [])
        for e in near:
            if venue and clean(e.venue_name) != venue:
                continue
            ratio = SequenceMatcher(None, clean(r.title), clean(e.title)).ratio()
            if ratio >= 0.65 and (r.canonical_hash not in want or (-ratio, e.event_id) < want[r.canonical_hash]):
                want[r.canonical_hash] = (-ratio, e.event_id)
    got = {r.canonical_hash: (-r.ratio, r.event_id) for r in registry.QUERIES["j3_w2_best_match"](spark, sf).collect()}
    assert got and got == {k: (-round(-x, 9), e) for k, (x, e) in want.items()}


def test_imports_without_the_training_data_package(tmp_path):
    """The entry file gives the other queries where that package and its pipeline aren't there."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    (tmp_path / "fairgrid").mkdir()
    for p in (ROOT / "fairgrid").rglob("*.py"):
        to = tmp_path / p.relative_to(ROOT)
        if "llm" not in p.relative_to(ROOT).parts:
            to.parent.mkdir(exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') or k == 'pipeline' for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)
