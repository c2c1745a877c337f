import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairgrid.llm import suffix_dedup as S


def plain(rows, length):
    """Every window of every text, in the order of ids and texts."""
    seen, out = set(), []
    for i, text in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            window = text[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not gone[n - 1] if n else bool(g) for n, g in enumerate(gone))
        out.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé日") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [say(25) for _ in range(4)]
    rows = []
    for i in range(n):
        text = say(rng.randrange(1, 60))
        if rng.random() < 0.5:
            text += rng.choice(["", " ", "\n"]) + rng.choice(passages) + say(rng.randrange(0, 9))
        if rng.random() < 0.3 and rows:
            old = rng.choice(rows)[1] or ""
            at = rng.randrange(len(old) + 1)
            text = old[:at] + rng.choice(["", "x", "changed words"]) + old[at:]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("hot, block_bytes", [(S.HOT, S.BLOCK_BYTES), (2, 3000), (S.HOT, 500)])
def test_against_every_window(spark, hot, block_bytes):
    rows = corpus(3, 120)
    rows += [(200, "a" * 1500), (201, "a" * 400 + "b"), (202, "ab" * 300), (203, None), (204, ""), (205, "x" * 99), (206, "x" * 100), (207, "x" * 100)]
    rows += [(None, rows[5][1]), (None, "no id " * 40), (7, rows[7][1]), (7, "second text of this id " * 9), (-4, rows[9][1]), (300, "é" * 70), (301, "é" * 60)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, block string, kind int").repartition(5)
    assert got(S.remove_repeats(df, hot=hot, block_bytes=block_bytes)) == plain(rows, S.LENGTH)


def test_other_lengths_and_long_texts(spark, monkeypatch):
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.remove_repeats(df, 20, 5)) == plain(rows, 20)
    rng = random.Random(1)
    long = [(1, "".join(rng.choice("abcdefgh ") for _ in range(400_000))), (2, "z" * 300_000)]
    long.append((3, "start " + long[0][1][1000:350_000] + " end"))
    out = {r[0]: r[1:4] for r in got(S.remove_repeats(spark.createDataFrame(long, "doc_id long, text string")))}
    assert out == {1: (400_000, 0, 0), 2: (300_000, 299_900 + 99, 1), 3: (349_010, 349_000, 1)}


def test_empty_table(spark):
    assert got(S.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert got(S.remove_repeats(spark.createDataFrame([(1, None)], "doc_id int, text string"))) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


@given(st.lists(st.integers(0, 3), min_size=30, max_size=80), st.integers(8, 21))
@settings(max_examples=60, deadline=None)
def test_radix_passes_find_equal_windows(letters, length):
    data = bytes(97 + x for x in letters)
    window = np.arange(len(data) - length + 1)
    which, same = S.equal_windows(np.frombuffer(data, np.uint8), window, np.zeros(len(window), int), length)
    want = {}
    for w in window:
        want.setdefault(data[w : w + length], set()).add(int(w))
    found = {}
    for w, c in zip(which, same, strict=True):
        found.setdefault(int(c), set()).add(int(w))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_texts_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame(corpus(1, 30), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    out = S.remove_repeats(spark.read.parquet(str(tmp_path / "d")))
    assert len(out.collect()) == 30
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") == 1
