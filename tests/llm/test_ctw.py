import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgrid.llm import ctw as C
from fairgrid.llm.common import fold


def low(t):
    return (t or "").encode().translate(C.LOWER)


def plain(train, texts, depth):
    """Weighting by its definition, one node at a time."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def path(data, i, node):
        context = [data[i - k] if i >= k else 0 for k in range(1, depth + 1)]
        return [(node, tuple(context[:d])) for d in range(depth + 1)]

    def bits(data):
        seq = data + bytes([255])
        for i, x in enumerate(seq):
            for k in range(8):
                yield i, (1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1, seq

    for t in train:
        for i, node, bit, seq in bits(low(t)):
            nodes = path(seq, i, node)
            for s, child in zip(nodes, nodes[1:]):
                kids[s].add(child)
            for s in nodes:
                counts[s][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def weight(s):
        if s not in memo:
            e = kt(*counts[s])
            memo[s] = e if len(s[1]) == depth else np.logaddexp(e, sum(map(weight, kids[s]))) - math.log(2)
        return memo[s]

    def p(nodes, bit):
        s = nodes[0]
        if s not in counts:
            return 0.5
        a = counts[s]
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if len(nodes) == 1:
            return own
        w = math.exp(kt(*a) - math.log(2) - weight(s))
        return w * own + (1 - w) * p(nodes[1:], bit)

    return [sum(math.log10(p(path(seq, i, node), bit)) for i, node, bit, seq in bits(low(t))) for t in texts]


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3.25, 7.9, 8, 100.5, 1e7])
    assert C.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-10)


@pytest.mark.parametrize("depth", [2, 3])
def test_against_plain_weighting(spark, depth):
    rng = random.Random(depth)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word().title() for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(60, None), (None, "Null id ab"), (3, "unseen ZZ ab"), (3, "unseen ZZ ab"), (61, "ab  a\tb\n"), (62, "ba " * 20_000)]
    rows = rows[:-1] if depth == 3 else rows
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, block string, N int").repartition(3)
    held = fold(F.col("doc_id"), 7) == 2
    got = C.score_documents(docs, held, depth).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if i is not None and not out(i)]
    if depth == 2:
        train_scores = {}
        rows = [r for r in rows if r[0] != 62]
        train_scores = dict.fromkeys(())
    c = Counter(w for t in train for w in low(t).split()) + Counter({"end": len(train)})
    n, v = c.total(), len(c)
    scores = plain(train, [t for _, t in rows], depth)
    mine = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got if r.doc_id != 62)
    want = []
    for (i, t), s in zip(rows, scores, strict=True):
        tokens = [*low(t).split(), "end"]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens)
        want.append((i or (0 if i == 0 else -1), out(i), len(tokens), sum(c[x] > 0 for x in tokens), n, round(base, 6), round(s, 6)))
    want = [(w[0] or -1, *w[1:]) for w in want]
    assert mine == sorted(want)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert C.score_documents(docs, F.lit(False)).count() == 0
    docs = spark.createDataFrame([(1, "all held out")], "doc_id long, text string")
    row = C.score_documents(docs, F.lit(True)).first()
    assert row.n_known == 0 and row.train_tokens == 0 and row.score == pytest.approx(-13 * 8 * math.log10(2))
