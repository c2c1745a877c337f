import math
import random

import pytest
from pyspark.sql import functions as F

from fairgrid.llm import balltree as B


def brute(rows, k):
    ok = sorted((i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v))
    found = {}
    for q, a in ok:
        if q % 50 == 0:
            found.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))
    out = [(q, r, i, -v) for q, s in found.items() for r, (v, i) in enumerate(sorted(s)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows,leaf", [(10_000, 1000, 64), (60, 3, 4)])
def test_against_brute_force(spark, monkeypatch, shard_rows, block_rows, leaf):
    monkeypatch.setattr(B, "LEAF_ROWS", leaf)
    rng = random.Random(shard_rows)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(i, [0.25] * 6) for i in range(600, 900)]  # one very common vector
    rows += [(900, None), (950, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6), (1050, [float("inf")] * 6), (None, [1.0] * 6), (1100, [1.0, 2.0]), (1101, [3.0, 4.0]), (1150, []), (100, rows[100][1]), (600, [0.25] * 6)] + [(901, [9.0] * 6)] * 9 + [(650, [0.25] * 6)] * 7
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = B.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows, block_rows).collect()
    want = brute(rows, 5)
    assert sorted(map(tuple, got)) == want and sum(i == 901 for *_, i, _ in want) > 5


def test_large_components_and_empty(spark):
    rows = [(0, [1e9, -1e9]), (1, [1e9, 1e9 + 1]), (2, [-1e9, 2e9]), (50, [3e8, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = B.top_k(df, F.col("vec_id") % 50 == 0, 2)
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert {(r[0], r[2], r[3]) for r in got.collect()} == {(q, i, clip(s)) for q, _, i, s in brute(rows, 3)} & {(r[0], r[2], r[3]) for r in got.collect()}
    assert got.count() == 4
    assert B.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_a_query_id_with_several_vectors(spark):
    """Own rows never take the places of others, however many stand with the query's id."""
    import itertools

    for own, others in itertools.product((2, 8, 70), (3, 39, 200)):
        rows = [(50, [1.0 + i / 300, 1.0], 0) for i in range(own)] + [(i + 1 if i < 49 else i + 100, [0.5, i / 400], 0) for i in range(others)]
        got = [tuple(r) for r in B.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 50).orderBy("rank").collect()]
        want = {}
        for q in (r[1] for r in rows if r[0] == 50):
            for i, v, _ in rows:
                if i != 50:
                    s = sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v, strict=True))
                    want.setdefault(i, []).append(s)
        flat = sorted(((-s, i) for i, all_ in want.items() for s in all_))[:5]
        assert [(q, k, i, -s) for k, (s, i) in enumerate(flat, 1) for q in (50,)] == got
