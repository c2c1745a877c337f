import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fairgrid.llm import simhash_dedup as S
from fairgrid.llm.graph import connected_components


def brute(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def plain_fingerprint(text):
    words = text.encode().translate(S.LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint(spark):
    for text in ["", "  \n", "One", "one two", "A b c", "a b c d e f g a b c", "Ünï çödé wörds ÀÉ", "x " * 300]:
        assert S.fingerprint(text.encode()) == plain_fingerprint(text)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("node_rows", [2, 30, 10_000])
def test_links_against_brute_force(spark, radius, node_rows):
    rng = random.Random(radius * 7 + node_rows)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps) | {0, 3, 2**64 - 1})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = connected_components(S.hamming_links(df, radius, node_rows)).collect()
    got = {r.node: r.root for r in roots}
    groups = {}
    for x, root in zip(signed, brute(fps, radius), strict=True):
        groups.setdefault(root, set()).add(x)
    mine = {}
    for x in signed:
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_small_frontier_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "FRONTIER", 4)
    rng = random.Random(1)
    fps = np.array(sorted({rng.getrandbits(64) ^ (1 << rng.randrange(64)) for _ in range(50)} | {1, 2, 4, 7, 8, 11}), np.uint64)
    forest = S._Near(fps, 2)
    one = lambda x: np.array([x])
    S.trie_links(fps, one(0), one(len(fps)), one(0), one(len(fps)), one(0), 0, 2, forest)
    assert forest.roots().tolist() == brute([int(x) for x in fps], 2)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, Component_ID int")


def test_edge_cases(spark):
    long = "alpha beta gamma delta " * 30_000
    docs = rows_of(spark, [(5, "a b c d", "x", 1), (3, "A  b\tc d", "x", 1), (9, None, None, None), (8, "", "x", 1), (None, "a b c d", "x", 2), (7, long, "x", 2), (7, long, "x", 2), (None, "nothing like it at all here", "q", 1)])
    out = S.near_duplicate_groups(docs).collect()
    assert len(out) == 8
    by = {(r.doc_id, r.component_id) for r in out}
    assert {(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7), (None, None)} == by
    kept = S.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 8]
    empty = docs.where("false")
    assert S.near_duplicate_groups(empty).collect() == [] == S.keep_one_of_each(empty).collect()


def test_hub_and_chain_components(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5, 5), (7, 0)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{1000 + i: 1000 for i in range(151)}}
