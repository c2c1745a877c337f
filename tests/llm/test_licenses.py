import random
import re

from fairgrid.llm import licenses as L


def toks(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = toks(text)
    starts, labels = [], set()
    for phrase, label in L.BASE.items():
        x = phrase.split()
        hit = [i for i in range(len(w)) if w[i : i + len(x)] == x]
        starts += hit
        if hit:
            labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_against_plain_scan(spark):
    rng = random.Random(2)
    notices = [n for _, n, _ in L.TEMPLATES] + ["Released under the MIT License.", "APACHE LICENSE, Version 2.0", "CC BY-NC 4.0", "under the the mit license under the mit license", "Mit License"]
    filler = ["über", "the", "license", "of", "under", "cc", "by", "Straße", "2", "version", "wörd", "K", "mit"]
    rows = []
    for i in range(150):
        w = [rng.choice(filler) for _ in range(rng.randint(0, 40))]
        if i % 3:
            w.insert(rng.randint(0, len(w)), rng.choice(notices))
        rows.append((i, " ".join(w), "x"))
    rows += [(None, None, "x"), (7, "", "x"), (7, "", "x"), (200, "word " * 50_000 + notices[0], "x"), (201, "under the mit licenſe İ apache license — version 2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    out = L.scan_documents(docs).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out], key=key) == sorted([(i, *brute(t)) for i, t, _ in rows], key=key)
    by = {r.doc_id: r for r in out}
    assert by[200].labels == "mit" and by[200].base_labels == "" and 0.99 < by[200].score <= 1
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)
    assert by[None].labels == "" and by[None].score == 0
    assert L.scan_documents(docs.where("false")).count() == 0


def test_each_template_is_found_and_random_words_are_not(spark):
    rows = [(i, f"Foo bar. {n}. Some more text.") for i, (_, n, _) in enumerate(L.TEMPLATES)]
    rows += [(100 + i, " ".join(random.Random(i).sample(n.split(), len(n.split())))) for i, (_, n, _) in enumerate(L.TEMPLATES) if len(n.split()) > 9]
    out = {r.doc_id: r for r in L.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(L.TEMPLATES):
        assert label in out[i].labels.split(","), L.TEMPLATES[i]
    assert all(r.labels == "" for i, r in out.items() if i >= 100)


def test_labels_against_every_start_with_a_long_licence_text(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7)))
    long = " ".join(word() for _ in range(400))
    templates = [*L.TEMPLATES, ("long-1", long, " ".join(long.split()[50:55]))]
    notices = [n for _, n, _ in templates] + [long] * 4
    rows = []
    for i in range(160):
        w = [rng.choice(["the", "license", "of", "software", word()]) for _ in range(rng.randint(0, 60))]
        for _ in range(i % 3):
            x = rng.choice(notices).split()
            for _ in range(rng.randint(0, 1 + len(x) // 4)):  # words changed, so that some fall below the cover
                x[rng.randrange(len(x))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = x
        rows.append((i, " ".join(w)))
    docs = {i: toks(t) for i, t in rows}
    n = {}
    for w in docs.values():
        for x in set(w):
            n[x] = n.get(x, 0) + 1
    weight = lambda x: max(1e-9, L.math.log((len(rows) + 1) / (n.get(x, 0) + 1)))
    want = {}
    for i, w in docs.items():
        want[i] = set()
        for label, notice, phrase in templates:
            x, p = notice.split(), phrase.split()
            for s in range(len(w)):
                part = w[s : s + len(x)]
                cover = sum(weight(a) for a, b in zip(x, part) if a == b) / sum(map(weight, x))
                if cover >= L.COVER and any(part[o : o + len(p)] == p for o in range(len(part) - len(p) + 1)):
                    want[i].add(label)
        want[i] |= set(filter(None, brute(dict(rows)[i])[4].split(",")))
    out = {r.doc_id: set(filter(None, r.labels.split(","))) for r in L.scan_documents(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert out == want and sum("long-1" in v for v in want.values()) > 5


def test_no_label_is_lost_among_many_licence_words(spark):
    """A notice whose words are frequent, after all other licence words: more kinds than look up postings by their rank."""
    notice = "licensed under cc by sa 4 0"
    others = [w for w in L._vocabulary(L.TEMPLATES) if w not in notice.split()]
    rows = [(i, f"text {i} {notice} end") for i in range(200)] + [(900, " ".join(others) + " . " + notice), (901, " ".join(reversed(others)) + " released under the mit license " + notice)]
    got = {r.doc_id: r.labels for r in L.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "cc-by-sa" and "cc-by-sa" in got[900].split(",") and {"cc-by-sa", "mit"} <= set(got[901].split(","))


def test_needed_words_are_in_every_place():
    """Whatever is left out of a template, if enough of its weight stands, two of the needed words do."""
    import random

    rng = random.Random(3)
    for _ in range(300):
        notice = [rng.randrange(12) for _ in range(rng.randrange(4, 30))]
        weights = [rng.choice([1e-9, 0.2, 1.0, 3.0, 7.0]) for _ in range(12)]
        words = set(L.needed(notice, weights, 2, 0.7))
        for _ in range(40):
            here = [q for q in range(len(notice)) if rng.random() < 0.8]
            if sum(weights[notice[q]] for q in here) >= 0.7 * sum(weights[w] for w in notice):
                assert sum(notice[q] in words for q in here) >= min(2, len(here)) or words == set(notice)
