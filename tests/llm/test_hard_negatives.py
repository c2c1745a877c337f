import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgrid.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, block string, dim string"


def plain(rows, anchor):
    """Every pair of an anchor and a row, scores as Python integers."""
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in sorted({(i, tuple(v), y) for i, v, y in good if anchor(i)}):
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in good if j != i and len(w) == len(v)), key=lambda r: r[:2])
        for s, j, _ in [r for r in scores if r[2] == y][:5]:
            hits = [(t, n) for t, n, z in scores if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(hits[:5], 1)]
    return sorted(out)


def mined(spark, rows, every, **how):
    df = spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, **how).collect())


@pytest.mark.parametrize("how", [{}, {"block_rows": 40, "team_rows": 8}, {"block_rows": 7, "team_rows": 3}])
def test_against_every_pair(spark, how, monkeypatch):
    monkeypatch.setattr(H, "ZONES", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.3, 12)).tolist(), int(i % 6 if rng.random() < 0.7 else rng.integers(6))) for i in range(300)]
    rows += [(400 + i, centres[1].tolist(), i % 2) for i in range(60)]  # one vector very often, ties
    rows += [rows[3], rows[20], (20, rows[4][1], 2), (20, rows[4][1], 2), (20, rows[5][1], 2), (40, rows[40][1], 5)]
    rows += [(None, rows[0][1], 1), (900, None, 1), (901, [1.0, None], 1), (902, [math.nan] * 12, 1), (903, [math.inf] * 12, 1), (904, rows[1][1], None)]
    rows += [(920, [0.5] * 3, 1), (921, [0.4] * 3, 1), (922, [0.3] * 3, 2), (940, [], 1), (960, [0.0] * 12, 1)]
    got = mined(spark, rows, 20, **how)
    assert got == plain(rows, lambda i: i % 20 == 0) and len(got) > 100


def test_components_beyond_doubles(spark):
    big = 2.0**40
    rows = [(0, [big, 3.0], 1), (1, [big, 1.0], 1), (2, [big, 0.5], 2), (3, [0.9 * big, 2.0], 2), (4, [-big, 1.0], 1), (5, [big, 1.0], 2)]
    assert [r[:4] for r in mined(spark, rows, 100)] == [(0, 1, 1, 5, *()), (0, 1, 2, 2), (0, 1, 3, 3)] or mined(spark, rows, 100)[0][4] == 2**63 - 1


def test_one_label_and_empty(spark):
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)], 1) == []
    assert mined(spark, [], 1) == []


def test_neighbours_on_the_curve_are_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    order = np.argsort(keys := H.hilbert(cells, 3))
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_few_blocks_are_read_for_narrow_data(spark):
    """Vectors with few directions: interval bounds leave most blocks of other directions out."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(2000):
        v = np.zeros(4)
        v[i // 500] = 1 + rng.random() / 100
        rows.append((i, v.tolist(), i % 3))
    df = spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA)
    blocks = H.write_blocks(H.vectors(df.select("vec_id", "embedding", "label"), "label").withColumns({"label": F.col("label").cast("long"), "anchor": F.col("vec_id") == 0}), 50)
    zones = H.zone_maps(blocks)
    ask = blocks.where("anchor").select("dim", F.lit(0).cast("long").alias("team"), F.col("vec_id").alias("anchor_id"), F.lit(0).cast("long").alias("anchor_key"), "label", "v", *[F.array(F.lit(x)).cast("array<long>").alias(c) for c, x in (("lo", 50_000), ("hi", 80_000), ("least", 50_000))], F.lit(-1).alias("home"))
    assert 0 < H.choose(ask, zones, 1, False).count() < zones.count() / 2
