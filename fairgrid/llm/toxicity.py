"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

Ordinary and toxic text each have a bigram model over token counts. Bigrams
back off to continuation counts (how many words a word follows), these to what
both classes say: an expression of one class alone has next to nothing there.
Discounts are below one, from counts of counts; a count of one goes to the
backoff whole. A third order reads words byte by byte, for expressions met
once or never that begin as known ones: each class says how a word's beginning
goes on, by the documents that have it, counts of one included, and backs off
to the pooled counts of both. A text is read in three ways, all of them
differences of log-likelihoods: over all of it, by the bigram models and by
token; over the WINDOW tokens where it is largest, by their lower order and by
token, as one expression makes a long text toxic; and for the LOUDEST of its
words, byte by byte. A logistic fit on documents kept back weighs the three.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Shared, cut

#: Labelled documents that a model is made of, ordinary and toxic.
SAMPLE = (16_000, 4000)
#: Tokens over which log-likelihoods are compared and divided by their number.
WINDOW = 3
#: Bytes of a word that are read one by one, and the words of a text, by largest difference, whose mean is taken.
STEM, LOUDEST = 12, 2
#: Words' counts that a task holds at a time.
HELD = 200_000
#: Bytes of texts that are read together, so that a word of several is looked up once.
BLOCK = 2 << 20
#: What the shared backoff gives to each word beside what both classes say.
BETA = 0.5
THRESHOLD = 0.3

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(data: bytes) -> list[bytes]:
    """A text's words: digits, letters of either case and whatever isn't ASCII."""
    return _WORD.findall(data.translate(LOWER))


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def token_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of a text's words."""
    return _hashes(_words(data))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    v, w = v.view(np.uint64), w.view(np.uint64)
    x = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = (Counter(), Counter())
    for b in batches:
        for data, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = token_hashes(data)
            n[y].update(zip(np.concatenate(([0], h[:-1])).tolist(), h.tolist(), strict=True))
    keys = list({*n[0], *n[1]})
    for at in range(0, len(keys), 1 << 16):
        some = keys[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([k[0] for k in some], [k[1] for k in some], [n[0][k] for k in some], [n[1][k] for k in some])], ["v", "w", "n0", "n1"])


def stems(data: bytes) -> list[bytes]:
    """A text's distinct words, each with an end byte and of STEM bytes at most."""
    return sorted({(w + b"\0")[:STEM] for w in {*_words(data)}})


def _beginnings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of stems' first byte, first two bytes, ... by row, and how many bytes each has; the end byte is a zero, as what fills a row."""
    fixed = np.array(words, f"S{STEM}")
    size = np.minimum(np.char.str_len(fixed) + 1, STEM)
    of = fixed.view(np.uint8).reshape(len(words), STEM)
    out, h = np.empty((len(words), STEM), np.int64), np.zeros(len(words), np.int64)
    for k in range(STEM):
        h = out[:, k] = _pair(h, of[:, k].astype(np.int64) + 1)
    return out, size


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        keys = list({*n[0], *n[1]})
        columns = [pa.array(keys, pa.binary()), *(pa.array([n[y][k] for k in keys], pa.int64()) for y in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, ["w", "n0", "n1"])

    n = (Counter(), Counter())
    for b in batches:
        for data, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n[y].update(stems(data))
            if len(n[0]) + len(n[1]) > HELD:
                yield rows()
                n = (Counter(), Counter())
    yield rows()


def discount(ones: int, twos: int) -> float:
    """The Kneser-Ney discount of counts of two or more, by how many counts are one and two; between 0 and 1."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


@dataclass
class Model:
    """Sorted keys with values for ordinary (0) and toxic (1) text; see fit(). share: what every text scores if a class is missing."""

    words: np.ndarray
    unigram: np.ndarray  # (2, words): continuation probability, backoff included
    unseen: np.ndarray  # (2,) share of the shared distribution
    base: float  # shared probability of a word that isn't in words
    contexts: np.ndarray
    total: np.ndarray  # (2, contexts): count of a context
    gamma: np.ndarray  # (2, contexts): backoff mass of a context
    pairs: np.ndarray
    seen: np.ndarray  # (2, pairs): discounted count
    window: int
    weights: tuple[float, ...] = (1.0, 1.0, 1.0, 0.0)
    beginnings: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))  # log-likelihood difference of a beginning
    leave: np.ndarray = field(default_factory=lambda: np.zeros(1))  # that of a byte that no word has after it
    start: float = 0.0  # that of a first byte that no word has

    def ratios(self, h: np.ndarray, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | toxic) - log P(word | ordinary), token by token: given the word before, and by the lower order.

        h: hashes of distinct words; w: the tokens, as places in h; first: which tokens have none before.
        """
        i, ok = _find(self.words, h)
        q = np.where(ok, self.unigram[:, i], (self.unseen * self.base)[:, None])
        single = (np.log(q[1]) - np.log(q[0]))[w]
        before = np.concatenate((h, np.zeros(1, np.int64)))
        v = np.concatenate((np.full(1, len(h)), w[:-1]))
        v[first] = len(h)
        j, met = _find(self.contexts, before)
        at = np.flatnonzero(met[v])  # after other words the lower order is all there is
        v, w = v[at], w[at]
        k, both = _find(self.pairs, _pair(before[v], h[w]))
        p = []
        for c in (0, 1):
            t = self.total[c, j][v]
            g = np.where(t > 0, self.gamma[c, j][v], 1.0)
            p.append(np.where(both & (t > 0), self.seen[c, k] / np.maximum(t, 1), 0.0) + g * q[c][w])
        pairs = single.copy()
        pairs[at] = np.log(p[1]) - np.log(p[0])
        return pairs, single

    def spell(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of stems() by their bytes: that of the longest beginning met, and of what leaves it."""
        hashes, size = _beginnings(words)
        rows, low, high, at = np.arange(len(words)), np.zeros(len(words), int), size.copy(), np.zeros(len(words), int)
        for _ in range(STEM.bit_length()):  # all beginnings of one that was met were met too
            middle = (low + high + 1) // 2
            i, ok = _find(self.beginnings, hashes[rows, np.maximum(middle, 1) - 1])
            ok &= middle > 0
            low, high, at = np.where(ok, middle, low), np.where(ok, high, np.maximum(middle - 1, low)), np.where(ok, i, at)
        return np.where(low > 0, self.gain[at] + np.where(low < size, self.leave[at], 0.0), self.start)

    def readings(self, texts: list[bytes]) -> np.ndarray:
        """By row, the differences of a text's two log-likelihoods: by token, of the whole text and of its largest window (all of it, if shorter), and of its loudest words by their bytes; 0 for no words."""
        out, at, size = [], 0, 0
        for end, t in enumerate(texts, 1):
            size += len(t)
            if size >= BLOCK:
                out.append(self._block(texts[at:end]))
                at, size = end, 0
        return np.concatenate([*out, self._block(texts[at:])])

    def _block(self, texts: list[bytes]) -> np.ndarray:
        split = [*map(_words, texts)]
        words = list(set().union(*split))
        out = np.zeros((len(texts), 3))
        if not words:
            return out
        place = dict(zip(words, range(len(words)), strict=True))
        ends = np.cumsum([len(s) for s in split])
        w = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]))
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
        pairs, single = self.ratios(_hashes(words), w, starts[starts < ends])
        stem: dict[bytes, int] = {}
        of = np.array([stem.setdefault((x + b"\0")[:STEM], len(stem)) for x in words])[w]
        loud = self.spell(list(stem))[of]
        sums = sum(single[k : len(single) - self.window + 1 + k] for k in range(self.window)) if len(single) >= self.window else single
        for r, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            if a < b:
                part = single[a:b].mean() if b - a < self.window else sums[a : b - self.window + 1].max() / self.window
                top, left, kinds = [], loud[a:b], of[a:b]
                while len(top) < LOUDEST and len(left):
                    i = left.argmax()
                    top.append(left[i])
                    left, kinds = left[others := kinds != kinds[i]], kinds[others]
                out[r] = pairs[a:b].mean(), part, sum(top) / len(top)
        return out

    def compare(self, data: bytes) -> tuple[float, float, float]:
        """The readings of one text."""
        return tuple(self.readings([data])[0].tolist())

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = weighed(self.readings(texts), self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def score(self, data: bytes) -> float:
        return float(self.scores([data])[0])


def weighed(x: np.ndarray, t: Iterable[float]) -> np.ndarray:
    """A weighted sum of columns that gives a row the same value whatever rows are beside it."""
    return sum(x[:, k] * c for k, c in enumerate(t))


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
    return i, keys[i] == x


def kneser_ney(words: dict[str, np.ndarray], contexts: dict[str, np.ndarray], pairs: dict[str, np.ndarray], met: np.ndarray, distinct: int, lower: tuple[float, float], upper: tuple[float, float], window: int = WINDOW) -> Model:
    """A model of tables that may leave out counts of one, which act by the backoff alone.

    words: w with met0 and met1, the distinct words before it by class;
    contexts: v with n0 and n1 (its count) and k0 and k1 (what discounts leave
    of its pairs); pairs: v, w, n0, n1. met: by class, the distinct pairs of
    all; distinct: the number of words of all; lower, upper: discounts by class.
    """
    one = lambda t: t if len(next(iter(t.values()))) else {k: np.zeros(1, np.int64) for k in t}
    words, contexts, pairs = one(words), one(contexts), one(pairs)
    left_of = lambda n, d: np.where(n > 1, n - np.array(d)[:, None], 0.0)
    n = np.stack((words["met0"], words["met1"])).astype(float)
    met = np.maximum(1, met)[:, None]
    shared = (n / met).min(0) * met.sum() + BETA
    whole = shared.sum() + BETA * (distinct - len(shared) + 1)
    left = left_of(n, lower)
    unseen = 1 - (left / met).sum(1)
    unigram = left / met + unseen[:, None] * (shared / whole)
    total = np.stack((contexts["n0"], contexts["n1"])).astype(float)
    kept = np.stack((contexts["k0"], contexts["k1"])).astype(float)
    gamma = np.where(total > 0, 1 - kept / np.maximum(total, 1), 1.0)
    key = _pair(pairs["v"], pairs["w"])
    by = [np.argsort(x) for x in (words["w"], contexts["v"], key)]
    seen = left_of(np.stack((pairs["n0"], pairs["n1"])).astype(float), upper)
    return Model(words["w"][by[0]], unigram[:, by[0]], unseen, BETA / whole, contexts["v"][by[1]], total[:, by[1]], gamma[:, by[1]], key[by[2]], seen[:, by[2]], window)


def spelling(taken: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of (text, y) rows: hashes of words' beginnings, sorted, with the gain and leave of each, and the start; see Model.

    A class says (n - d) / N + d k / N * pool of a byte: n documents' words go
    on with it of N that begin so, k different bytes do, d is the class's
    discount, pool the share in both classes together. A beginning met once in
    all is kept without those that follow from it, as nothing is said there.
    """
    words = taken.select("text", "y").mapInArrow(_stem_counts, "w binary, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    nodes = words.select(F.explode(F.expr("transform(sequence(1, length(w)), k -> substring(w, 1, k))")).alias("p"), "n0", "n1")
    nodes = cut(nodes.groupBy("p").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    ones = nodes.agg(*(F.count_if(F.col(f"n{c}") == n) for c in (0, 1) for n in (1, 2))).first()
    d = discount(*ones[:2]), discount(*ones[2:])
    inner = nodes.groupBy(F.expr("substring(p, 1, length(p) - 1)").alias("before")).agg(*(f(c) for c in (0, 1) for f in (lambda c: F.sum(f"n{c}").alias(f"all{c}"), lambda c: F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}"))))
    gamma = lambda c: F.when(F.col(f"all{c}") > 0, d[c] * F.col(f"k{c}") / F.col(f"all{c}")).otherwise(1.0)
    inner = cut(inner.where("all0 + all1 > 1").select("before", "all0", "all1", gamma(0).alias("g0"), gamma(1).alias("g1")))
    away = (F.ln("g1") - F.ln("g0")).alias("leave")
    pool = (F.col("n0") + F.col("n1")) / (F.col("all0") + F.col("all1"))
    p = [F.when(F.col(f"n{c}") > 0, (F.col(f"n{c}") - d[c]) / F.col(f"all{c}")).otherwise(0.0) + F.col(f"g{c}") * pool for c in (0, 1)]
    gains = nodes.withColumn("before", F.expr("substring(p, 1, length(p) - 1)")).join(inner, "before").select("p", (F.ln(p[1]) - F.ln(p[0])).alias("gain"))
    leaves = inner.select(F.col("before").alias("p"), away)
    t = gains.join(leaves, "p", "left").select("p", F.length("p").alias("size"), "gain", F.coalesce("leave", F.lit(0.0)).alias("leave")).toArrow()
    start = leaves.where("length(p) = 0").first()
    if not len(t):
        return np.zeros(1, np.int64), np.zeros(1), np.zeros(1), float(start["leave"]) if start else 0.0
    hashes, _ = _beginnings(t["p"].to_pylist())
    size, rows = t["size"].to_numpy(), np.arange(len(t))
    by = np.argsort(key := hashes[rows, size - 1])
    key, size, hashes, total, leave = key[by], size[by], hashes[by], t["gain"].to_numpy()[by], t["leave"].to_numpy()[by]
    for k in range(2, STEM + 1):
        here = np.flatnonzero(size == k)
        total[here] += total[_find(key, hashes[here, k - 2])[0]]
    return key, total, leave, float(start["leave"]) if start else 0.0


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of the columns of x, none of them below zero, and an offset, by Newton's method with a small penalty."""
    on = list(range(x.shape[1]))
    while True:
        a, t = np.concatenate((x[:, on], np.ones((len(x), 1))), 1), np.zeros(len(on) + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(t))
            t = t + np.clip(np.linalg.solve(h, a.T @ (y - p) - 1e-3 * t), -5, 5)
        if not (t[:-1] < 0).any():
            out = np.zeros(x.shape[1] + 1)
            out[on], out[-1] = t[:-1], t[-1]
            return out
        on.pop(int(np.argmin(t[:-1])))


def cut_at(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where to part the classes: the middle of the widest gap with the least weight on the wrong side."""
    order = np.argsort(m)
    m, y, weight = m[order], y[order], weight[order]
    wrong = np.concatenate(([0.0], np.cumsum(np.where(y > 0, weight, -weight)))) + weight[y == 0].sum()
    gap = np.diff(np.concatenate(([m[0] - 1], m, [m[-1] + 1])))
    i = max(np.flatnonzero((gap > 0) & (wrong <= wrong[gap > 0].min() + 1e-9)), key=lambda k: gap[k])  # never between equal values
    return float((m[i - 1] if i else m[0] - 1) / 2 + (m[i] if i < len(m) else m[-1] + 1) / 2)


def fit(rows: DataFrame, sample: tuple[int, int] = SAMPLE, window: int = WINDOW) -> Model | float:
    """A model of (doc_id, text, y) rows, y 0 or 1; with a class missing the share of ones, which every text then scores (0 for no rows).

    Made of ``sample[y]`` documents of each class, those of the smallest
    xxhash64(doc_id), equal texts once; a fifth of them weighs the readings
    instead, with THRESHOLD where they part best. All counts are added up in
    Spark; words, contexts and pairs counted twice or more reach the driver, at
    most half the sample's tokens, and words' beginnings met twice or more with
    the bytes after them.
    """
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "y")
    total = dict(rows.groupBy("y").count().collect())
    if len(total) < 2:
        return float(max(total, default=0))
    some = None
    for y in (0, 1):
        ids = rows.where(F.col("y") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y])
        some = ids if some is None else some.union(ids)
    taken = rows.join(F.broadcast(some), "doc_id").select("text", "y", (F.crc32("text") % 5 == 0).alias("kept"))
    taken = cut(taken.groupBy(F.xxhash64("text"), "y", "kept").agg(F.first("text").alias("text")))
    counts = taken.where("not kept").select("text", "y").mapInArrow(_bigram_counts, "v long, w long, n0 long, n1 long").groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = cut(counts)
    words = cut(counts.groupBy("w").agg(F.count_if(F.col("n0") > 0).alias("met0"), F.count_if(F.col("n1") > 0).alias("met1")))
    of = lambda df, c: [x for k in (0, 1) for x in df.agg(F.count_if(F.col(f"{c}{k}") == 1), F.count_if(F.col(f"{c}{k}") == 2)).first()]
    met0, met1, distinct = words.agg(F.sum("met0"), F.sum("met1"), F.count("*")).first()
    if not distinct:
        return total[1] / (total[0] + total[1])
    lower, upper = ((discount(*x[:2]), discount(*x[2:])) for x in (of(words, "met"), of(counts, "n")))
    left = lambda k: F.sum(F.when(F.col(f"n{k}") > 1, F.col(f"n{k}") - upper[k]).otherwise(0.0)).alias(f"k{k}")
    contexts = counts.groupBy("v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), left(0), left(1)).where("k0 + k1 > 0")
    several = words.where(F.greatest("met0", "met1") > 1), contexts, counts.where(F.greatest("n0", "n1") > 1)
    tables = [{c: t[c].to_numpy() for c in t.column_names} for t in (x.toArrow() for x in several)]
    model = kneser_ney(*tables, np.array([met0, met1], float), distinct, lower, upper, window)
    model.beginnings, model.gain, model.leave, model.start = spelling(taken.where("not kept"))
    del tables
    shared = Shared(rows, model)
    held = taken.where("kept").select("y", _compare_udf(shared)("text").alias("m")).select("y", "m.*").toArrow().sort_by([(c, "ascending") for c in ("whole", "part", "loud", "y")])
    shared.destroy()
    y, x = held["y"].to_numpy(), np.stack([held[c].to_numpy() for c in ("whole", "part", "loud")], 1)
    if len({*y}) == 2:
        *t, _ = logistic(x, y)
        t = t if any(t) else [0.0, 1.0, 0.0]
        # each class with the weight that it has among all rows
        weight = np.where(y > 0, total[1] / max(1, (y > 0).sum()), total[0] / max(1, (y == 0).sum()))
        model.weights = (*map(float, t), math.log(THRESHOLD / (1 - THRESHOLD)) - cut_at(weighed(x, t), y, weight))
    return model


_READINGS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("whole", "part", "loud")])


def _compare_udf(shared: Shared):
    @F.arrow_udf(_READINGS)
    def compare(text: pa.Array) -> pa.Array:
        rows = shared().readings(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["whole", "part", "loud"])

    return compare


def score_udf(docs: DataFrame, model: Model | float):
    """A column function text -> score from 0 to 1; a null text scores as an empty one."""
    if not isinstance(model, Model):
        return lambda text: F.lit(model)
    shared = Shared(docs, model)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared().scores(text.to_pylist()))

    return lambda text: score(F.coalesce(text, F.lit("")).cast("binary"))


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")
