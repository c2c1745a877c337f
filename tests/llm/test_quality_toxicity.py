import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgrid.llm import quality, toxicity
from fairgrid.llm.common import fold, labelled


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal value meets the dual one."""
    rng = np.random.default_rng(0)
    rows = [rng.choice(30, 6, replace=False) for _ in range(80)]
    values = [rng.normal(size=6) for _ in rows]
    y = np.where(rng.random(80) < 0.5, 1, -1)
    c = np.full(80, 0.7)
    w = quality.dual_coordinate_descent(rows, values, y, 30, c, 3000)
    objective = lambda w: w @ w / 2 + sum(ci * max(0, 1 - yi * (v @ w[f] + w[30])) for f, v, yi, ci in zip(rows, values, y, c))
    best = objective(w)
    for _ in range(300):
        assert objective(w + rng.normal(size=31) * 0.01) >= best - 1e-3


def test_indicators_are_a_set_of_the_whole_text():
    a = quality.indicators(b"The the cat!! ")
    assert (np.diff(a) > 0).all() and a.max() < 1 << quality.BITS
    long = ("word " * 50_000 + "rareend").encode()
    assert set(quality.indicators(b"x rareend")) & set(quality.indicators(long))
    assert len(quality.indicators(b"")) == 1 == len(quality.indicators(b" "))


def corpus(n=420):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w + "%%%" for w in words]
        if rude:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "numpty", "wazzock"]))
        rows.append((i, " ".join(words), "x"))
        if i % 4:
            labels.append((i, int(not bad), int(rude)))
    truth = {i: (q, t) for i, q, t in labels}
    rows += [(None, None, "x"), (9000, "", "x"), (9000, "", "x"), (9001, "plain words here " * 20_000, None)]
    return rows, labels + [(None, 1, 1), (3, 0, 1), (99_999, 1, 0)], truth


@pytest.mark.parametrize("module,label,n,r,at", [(quality, "quality", 3, 1, 0), (toxicity, "toxic", 4, 2, 1)])
def test_held_out_documents(spark, module, label, n, r, at):
    rows, labels, truth = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    used = labelled(docs, y, label, n, r)
    assert not any(held(row.doc_id, n, r) for row in used.select("doc_id").collect())
    model = module.fit(used)
    out = docs.select("doc_id", module.score_udf(docs, model)(F.col("text")).alias("s")).withColumn("p", module.predicted(F.col("s"))).collect()
    assert len(out) == len(rows) and all(0 <= x.s <= 1 for x in out)
    test = [(x.p, truth[x.doc_id][at]) for x in out if x.doc_id in truth and held(x.doc_id, n, r)]
    assert len(test) > 50 and np.mean([p == t for p, t in test]) > 0.95
    again = module.fit(used)
    scored = docs.select("doc_id", module.score_udf(docs, again)(F.col("text")).alias("s")).collect()
    assert sorted((str(x.doc_id), round(x.s, 9)) for x in out) == sorted((str(x.doc_id), round(x.s, 9)) for x in scored)


def test_missing_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    y = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    m = quality.fit(labelled(docs, y, "quality", 3, 7))
    assert {r[0] > 0.9 for r in docs.select(quality.score_udf(docs, m)(F.col("text"))).collect()} == {True}
    m = quality.fit(labelled(docs, y.where("false"), "quality", 3, 7))
    assert {r[0] for r in docs.select(quality.score_udf(docs, m)(F.col("text"))).collect()} == {0.5}
    for toxic, want in ((y, 0.0), (y.where("false"), 0.0), (y.withColumn("toxic", F.lit(1)), 1.0)):
        m = toxicity.fit(labelled(docs, toxic, "toxic", 4, 7))
        assert {r[0] for r in docs.select(toxicity.score_udf(docs, m)(F.col("text"))).collect()} == {want}
    m = quality.fit(labelled(docs, y.where("false"), "quality", 3, 7))
    assert docs.where("false").select(quality.score_udf(docs, m)(F.col("text"))).count() == 0
    assert fold is not None


def test_kneser_ney_against_a_plain_model(spark):
    """Both readings of a text against a model written out with dictionaries, and probabilities that add up to one."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda y: " ".join(rng.choices(vocabulary + ["vile", "foul"] * y, k=rng.randint(3, 30)))
    rows = [(i, text(i % 2), i % 2) for i in range(240)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y int"), window=3)
    learnt = {(t, y) for _, t, y in rows if zlib.crc32(t.encode()) % 5}
    n, met = [{}, {}], [{}, {}]
    for t, y in learnt:
        ws = ["<s>", *t.split()]
        for v, w in zip(ws, ws[1:]):
            n[y][v, w] = n[y].get((v, w), 0) + 1
    for y in (0, 1):
        for _, w in n[y]:
            met[y][w] = met[y].get(w, 0) + 1
    known = {*met[0], *met[1]}
    d = [toxicity.discount(*(list(x.values()).count(k) for k in (1, 2))) for x in n]
    e = [toxicity.discount(*(list(x.values()).count(k) for k in (1, 2))) for x in met]
    m = [sum(x.values()) for x in met]
    assert all(0 < x < 1 for x in d + e)
    some = [w for w in known if max(met[y].get(w, 0) for y in (0, 1)) > 1]
    shared = {w: min(met[y].get(w, 0) / m[y] for y in (0, 1)) * sum(m) + 0.5 for w in some}
    whole = sum(shared.values()) + 0.5 * (len(known) - len(some) + 1)

    def uni(y, w):
        left = lambda c: c - e[y] if c > 1 else 0
        rest = 1 - sum(map(left, met[y].values())) / m[y]
        return left(met[y].get(w, 0)) / m[y] + rest * shared.get(w, 0.5) / whole

    def bi(y, v, w):
        left = lambda c: c - d[y] if c > 1 else 0
        after = {b: c for (a, b), c in n[y].items() if a == v}
        total = sum(after.values())
        if not sum(map(left, after.values())):
            return uni(y, w)
        return left(after.get(w, 0)) / total + (1 - sum(map(left, after.values())) / total) * uni(y, w)

    for y in (0, 1):
        assert sum(uni(y, w) for w in known) + uni(y, "?") * 1 == pytest.approx(1, abs=1e-9)
    for t in ["w1 w2 vile w3", "foul", "w5 never seen w7 w8 w9 foul vile", *[t for _, t, _ in rows[:30]]]:
        ws = ["<s>", *t.split()]
        both = [np.log(bi(1, v, w) / bi(0, v, w)) for v, w in zip(ws, ws[1:])]
        single = [np.log(uni(1, w) / uni(0, w)) for w in ws[1:]]
        k = min(3, len(single))
        want = np.mean(both), max(np.mean(single[i : i + k]) for i in range(len(single) - k + 1))
        assert model.compare(t.encode())[:2] == pytest.approx(want, abs=1e-9)
    assert model.score(b"w1 w2 vile foul w3") > 0.3 > model.score(b"w1 w2 w3 w4")
    assert model.compare(b"") == (0.0, 0.0, 0.0) == model.compare(b" -- ")


def test_spelling_against_a_plain_model(spark, monkeypatch):
    """Words byte by byte against a model with dictionaries: known, new, long and cut words, and any order of what is held."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "é", "x"]) for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 12))] + [f"grob{word()}" for _ in range(2 * (i % 2))]), i % 2) for i in range(300)]
    docs = spark.createDataFrame([(t.encode(), y) for _, t, y in rows], "text binary, y int").repartition(3)
    monkeypatch.setattr(toxicity, "HELD", 50)
    keys, gain, leave, start = toxicity.spelling(docs)
    n = [{}, {}]
    for _, t, y in rows:
        for w in {(w.encode() + b"\0")[:12] for w in t.split()}:
            for k in range(1, len(w) + 1):
                n[y][w[:k]] = n[y].get(w[:k], 0) + 1
    d = [toxicity.discount(*(list(x.values()).count(k) for k in (1, 2))) for x in n]

    def plain(w):
        out = 0.0
        for k in range(len(w)):
            after = [{p: c for p, c in x.items() if len(p) == k + 1 and p[:k] == w[:k]} for x in n]
            total = [sum(x.values()) for x in after]
            if sum(total) < 2:
                return out
            rest = [d[y] * len(after[y]) / total[y] if total[y] else 1.0 for y in (0, 1)]
            c = [after[y].get(w[: k + 1], 0) for y in (0, 1)]
            if not sum(c):
                return out + np.log(rest[1] / rest[0])
            p = [(c[y] - d[y] if c[y] else 0) / (total[y] or 1) + rest[y] * sum(c) / sum(total) for y in (0, 1)]
            out += np.log(p[1] / p[0])
        return out

    zero = np.zeros(1, np.int64)
    model = toxicity.Model(zero, np.zeros((2, 1)), np.ones(2), 1.0, zero, np.zeros((2, 1)), np.zeros((2, 1)), zero, np.zeros((2, 1)), 3, beginnings=keys, gain=gain, leave=leave, start=start)
    words = sorted({w for _, t, _ in rows[:60] for w in toxicity.stems(t.encode())} | set(toxicity.stems(b"grob grobkalomikalomi grobzz zz q kalomizz grobka grobe")))
    want = {w: plain(w) for w in words}
    assert max(want.values()) > 1 > 0 > min(want.values())
    for some in (words, words[::3], words[20:50], words[:1]):
        assert model.spell(some) == pytest.approx([want[w] for w in some], abs=1e-9)
    text = rows[1][1].encode()
    assert model.compare(text + b" " + text)[2] == pytest.approx(np.mean(sorted(plain(w) for w in toxicity.stems(text))[-2:]))
    empty = toxicity.spelling(docs.where("false"))
    assert not any(x.any() for x in empty[:3]) and empty[3] == 0.0


def test_expressions_that_begin_as_known_ones(spark):
    """No toxic word of the held-out texts was seen before; their beginning was, and clean texts have it as a word."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7)))
    text = lambda y: " ".join(rng.sample([word() for _ in range(30)] + ["grobol"] * (not y) + [f"grobol{word()}" for _ in range(3 * y)], 30 + (3 if y else 1)))
    model = toxicity.fit(spark.createDataFrame([(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, text string, y int"))
    new = [(text(y), y) for y in [0, 1] * 40]
    assert np.mean([(model.score(t.encode()) >= toxicity.THRESHOLD) == y for t, y in new]) > 0.95


def test_cut_is_never_between_equal_values():
    m, y = np.array([0.0, 0.25, 0.25, 0.25, 4.0, 4.0, 9.0]), np.array([0, 0, 1, 0, 1, 1, 1])
    for order in ([0, 1, 2, 3, 4, 5, 6], [6, 2, 4, 3, 1, 0, 5], [3, 1, 2, 5, 6, 0, 4]):
        assert toxicity.cut_at(m[order], y[order], np.ones(7)) == pytest.approx(2.125)
    assert toxicity.cut_at(np.zeros(3), np.array([0, 1, 1]), np.ones(3)) == pytest.approx(-0.5)


def test_labels_go_to_the_texts(spark):
    """All labels up to the bound, about the bound of each class beyond it; one plan, in which no text is shuffled."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    y = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    all_ = {(r.doc_id, r.y) for r in labelled(docs, y, "toxic", 4, 2).collect()}
    assert all_ == {(i, int(i % 3 == 0)) for i in range(6000) if not held(i, 4, 2)}
    some = labelled(docs, y, "toxic", 4, 2, per_class=500)
    got = [(r.doc_id, r.y) for r in some.collect()]
    assert set(got) < all_ and len(set(got)) == len(got)
    assert all(400 < sum(k == c for _, k in got) < 600 for c in (0, 1))
    for df in (some, labelled(docs, y, "toxic", 4, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_texts_are_read_together(spark, monkeypatch):
    """Each word of several texts is looked up once, and a text's score doesn't depend on what is beside it."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(40)] + ["vile", "foul", "abcdefghijklmn", "abcdefghijklxy"] * (i % 2), k=rng.randint(1, 30))), i % 2) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    texts = [t.encode() for _, t, _ in rows] + [b"", b" -- ", b"vile", b"new w3", b"abcdefghijklxy Abcdefghijklmn"]
    spelt = []
    plain = toxicity.Model.spell
    monkeypatch.setattr(toxicity.Model, "spell", lambda self, words: spelt.extend(words) or plain(self, words))
    together = model.scores(texts)
    assert len(spelt) == len({*spelt}) == len({s for t in texts for s in toxicity.stems(t)})
    assert together.tolist() == [model.score(t) for t in texts]
    assert model.scores(texts[::-1]).tolist() == together[::-1].tolist() and not len(model.scores([]))
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    assert model.scores(texts).tolist() == together.tolist()
    for t, r in zip(texts, model.readings(texts), strict=True):
        loudest = sorted(plain(model, [s])[0] for s in toxicity.stems(t))[-toxicity.LOUDEST :]
        assert r[2] == pytest.approx(np.mean(loudest) if loudest else 0.0, abs=1e-12)
