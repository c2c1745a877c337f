import random
import re
from collections import Counter

from fairgrid.llm import decontaminate as D


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, threshold=0.8):
    found = set()
    for d, text in docs:
        w = toks(text)
        for i, item in items:
            x = toks(item)
            if not x:
                continue
            n = min(5, len(x))
            a = grams(x, n)
            for s in range(max(1, len(w) - len(x) + 1)):
                b = grams(w[s : s + len(x)], n)
                if sum((a & b).values()) / max(1, sum((a | b).values())) >= threshold:
                    found.add((d, i))
    return found


def test_against_all_windows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 45, 60])))) for i in range(25)]
    items += [(25, items[8][1].upper() + "!"), (26, "go go " * 12)]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randint(0, 80))]
        x = rng.choice(items)[1].split()
        kind = d % 6
        if kind == 1:
            x[rng.randrange(len(x))] = word()
        elif kind == 2:
            del x[: rng.randint(0, 2)]
        elif kind == 3:
            x.insert(len(x) // 2, word())
        elif kind == 4:
            x = x[: len(x) // 2]
        at = rng.randint(0, len(w))
        docs.append((d, " ".join(w[:at] + (x if kind else []) + w[at:])))
    docs.append((500, "so they go go go go go go go go go go go go go go go go go go go go go go go go on"))
    first = {}
    for i, t in items:
        first.setdefault(tuple(toks(t)), i)
    want = {(d, first[tuple(toks(dict(items)[i]))]) for d, i in brute(docs, items)}
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item) for r in D.contaminated(a, b).collect()}
    assert want == got and len(want) > 40
    out = D.report(a, b).collect()
    assert len(out) == len(docs) and {r.doc_id for r in out if r.contaminated} == {d for d, _ in want}
    kept = {r.doc_id for r in D.decontaminate(a, b).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_edge_cases(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, item, "a", 1), (1, item, "a", 1), (None, f"x {item} y", "b", 2), (2, None, None, None), (3, "", "c", 3), (4, "?! ...", "c", 3), (5, "z " * 60_000 + item, "c", 3)], "doc_id long, text string, h string, Text_Hash int")
    items = spark.createDataFrame([(7, item), (6, item.title()), (8, None), (9, ""), (None, "nothing here")], "item_id long, text string")
    out = [(r.doc_id, r.contaminated, r.n_items, r.item_ids) for r in D.report(docs, items).collect()]
    assert sorted(out, key=str) == sorted([(1, True, 1, "6")] * 2 + [(None, True, 1, "6"), (5, True, 1, "6")] + [(i, False, 0, "") for i in (2, 3, 4)], key=str)
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert D.report(docs.where("false"), items).count() == 0
    assert D.decontaminate(docs, items.where("false")).count() == 7


def test_parts_in_another_order(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([60, 75, 90, 120])]
    docs = []
    for d in range(40):
        w, x = [word() for _ in range(rng.randint(0, 150))], items[d % 4][1].split()
        cuts = sorted(rng.sample(range(1, len(x)), 1 + d % 3))
        parts = [x[a:b] for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True)]
        parts = parts[1:] + parts[:1]
        at = 0 if d % 5 == 0 else len(w) if d % 5 == 1 else rng.randint(0, len(w))
        docs.append((d, " ".join(w[:at] + sum(parts, []) + w[at:])))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(r.doc_id, r.item) for r in D.contaminated(a, b).collect()} == want and len(want) > 15


def test_what_just_meets_a_threshold_shares_a_rare_shingle(spark):
    """Texts shorter than their item that hold as many of its shingles as the threshold asks for, all of them the item's most frequent ones."""
    word = lambda k, i: f"{'abcdefgh'[k]}{'ijklmnopqr'[i // 10]}{'ijklmnopqr'[i % 10]}"
    for threshold, n in ((0.55, 55), (0.7, 70), (0.8, 80)):
        head = [word(0, i) for i in range(n + 4)]
        items = [(k, " ".join(head + [word(k + 1, i) for i in range(100 - n)])) for k in range(3)]
        docs = [(1, " ".join(head)), (2, " ".join(head[1:]))]
        want = {(1, k) for k in range(3)}
        assert brute(docs, items, threshold) == want
        a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert {(r.doc_id, r.item) for r in D.contaminated(a, b, threshold).collect()} == want


def test_rare_shingles_find_what_all_of_them_find(spark, monkeypatch):
    """Items that share most of their shingles, repeats in items and texts, texts cut short: every match by a join on all shingles, without a radius, is there."""
    rng = random.Random(17)
    parts = [" ".join(rng.choices("abcdefghijklmnopq", k=rng.randint(8, 14))) for _ in range(8)]
    items = [(i, " ".join(rng.choices(parts, k=rng.randint(2, 5)))) for i in range(30)]
    docs = []
    for d in range(150):
        x = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        at = rng.randint(0, 6)
        docs.append((d, " ".join(x[at:] if d % 2 else ["x"] * at + x + rng.choice(parts).split())))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda radius: {tuple(r) for r in D.contaminated(a, b, 0.8, radius).collect()}
    got = rows(D.RADIUS)
    monkeypatch.setattr(D, "_rare", lambda table, threshold: table.select("item", "n", D.F.explode("shingles").alias("h")).distinct())
    assert rows(63) == got and len(got) > 40
