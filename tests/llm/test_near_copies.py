import random

import pytest

import corpus_pipeline as P
from fairgrid.llm import near_copies as N


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} - {()}


def brute(docs, threshold=0.8):
    """Smallest id of each connected group."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= threshold * len(a | b) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {docs[find(i)][0] for i in range(len(docs))}


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.choice([3, 40, 90, 200]))] for _ in range(30)]
    line = [word() for _ in range(25)]
    docs = [(i, " ".join(w + (line if i % 3 else []))) for i, w in enumerate(base)]
    for i in range(90):  # copies with one to five words changed, left out or put in
        w = list(base[7 if i % 2 else rng.randrange(30)])
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [word()]
        docs.append((100 + i, " ".join(w)))
    return docs + [(300, ""), (301, None)]


@pytest.mark.parametrize(("group", "cell"), [(4096, 256), (4, 256), (4096, 6), (5, 4)])
def test_edited_copies_against_all_pairs(spark, monkeypatch, group, cell):
    docs = corpus()
    want = brute(docs)
    links = N.similar_links
    monkeypatch.setattr(N, "similar_links", lambda *a: links(*a, group=group, cell=cell))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r.doc_id for r in P.dedup_stage(spark, df, "").collect()]
    assert sorted(got) == sorted(want) and 40 < len(want) < len(docs) - 30
