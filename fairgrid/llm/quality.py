"""Document quality by Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a hinge-loss fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Shared

#: Buckets of the hashed n-grams: what a model is made of, whatever the corpus.
BITS = 18
#: Rows of each class in the sample that the linear model is fitted on (its class counts cover all labelled rows).
SAMPLE_PER_CLASS = 2000
ALPHA, C, EPOCHS, BLEND = 1.0, 1.0, 20, 0.75

_CLASS = bytearray(b"o" * 256)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = ord("s" if _c in " \t\n\r\x0b\x0c" else "A" if _c.isascii() and _c.isupper() else "a" if _c.isascii() and _c.islower() or _b >= 128 else "0" if _c.isascii() and _c.isdigit() else _c if 32 < _b < 127 else "o")
_CLASS = bytes(_CLASS)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)


def indicators(data: bytes) -> np.ndarray:
    """The distinct buckets of a whole text's n-grams (UTF-8).

    Word 1- and 2-grams without case; character 3-grams; 2- to 4-grams of the
    run-length-squeezed character classes; runs of repeated words up to three.
    A text without words has the one bucket of the empty n-gram.
    """
    words = data.translate(LOWER).split()
    w = np.fromiter(map(crc32, words), np.uint64, len(words))
    found = [_mix(np.array([len(words) == 0], np.uint64), 1)]
    if len(w):
        found += [_mix(w, 2), _mix(w[:-1] * np.uint64(31) + w[1:] * np.uint64(1_000_003), 3)]
        again = w[1:] == w[:-1]
        for n in range(1, 4):
            if again.any():
                found.append(_mix(np.array([n], np.uint64), 4))
            again = again[1:] & again[:-1]
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) > 2:
        found.append(_mix(a[:-2] | a[1:-1] << np.uint64(8) | a[2:] << np.uint64(16), 5))
    k = np.frombuffer(data.translate(_CLASS), np.uint8).astype(np.uint64)
    if len(k):
        k = k[np.concatenate(([True], k[1:] != k[:-1]))]
    gram = k
    for n in range(2, 5):
        if len(k) >= n:
            gram = gram[:-1] | k[n - 1 :] << np.uint64(8 * (n - 1))
            found.append(_mix(gram, 5 + n))
    return np.unique(np.concatenate(found)).astype(np.int64)


@dataclass
class Model:
    """weight: by bucket, log-count ratio times fitted weight; a, b: a margin's sigmoid."""

    weight: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weight[found].sum() / np.sqrt(max(1, len(found))) + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(found) + self.b, -30, 30))))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) of the L2-regularised hinge loss: min |w|^2/2 + sum c_i max(0, 1 - y_i w.x_i)."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    q = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            g = y[i] * (v @ w[f] + w[size]) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                alpha[i] = new
                w[f] += step * v
                w[size] += step
                moved = max(moved, abs(step))
        if moved < 1e-3 * c.max():
            break
    return w


def _platt(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid by Newton's method, with smoothed targets."""
    target = np.where(y > 0, (y > 0).sum() + 1, 1) / np.where(y > 0, (y > 0).sum() + 2, (y <= 0).sum() + 2)
    x = np.stack((m, np.ones_like(m)), 1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        t = t + np.clip(np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-6 * t), -5, 5)
    return (float(t[0]), float(t[1])) if t[0] > 0 else (1.0, 0.0)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, 1 << BITS), np.int64)
    for b in batches:
        for data, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n[y, indicators(data)] += 1
    some = np.flatnonzero(n.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0, some]), pa.array(n[1, some])], ["bucket", "n0", "n1"])


def _solve(ratio: Callable[[], np.ndarray], total: dict[int, int]):
    """(doc_id, y, found) of the whole sample to the model's weights by bucket; in bucket -1 its bias, a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        taken = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("y", "ascending")])
        y = taken["y"].to_numpy() * 2 - 1
        column = taken["found"].combine_chunks()
        ends = column.offsets.to_numpy()[1:-1]
        flat = column.values.to_numpy()
        found = np.split(flat, ends)
        values = np.split((ratio()[flat] / np.sqrt(np.repeat(size := [len(f) for f in found], size))).astype(np.float32), ends)
        kept = np.array([crc32(str(i).encode()) % 5 == 0 for i in taken["doc_id"].to_pylist()])
        if len({*y[kept]}) < 2 or len({*y[~kept]}) < 2:
            kept[:] = False
        fit_on = np.flatnonzero(~kept)
        share = np.array([(y[fit_on] < 0).mean(), (y[fit_on] > 0).mean()])
        c = C * 0.5 / share[(y[fit_on] > 0).astype(int)]
        w = dual_coordinate_descent([found[i] for i in fit_on], [values[i] for i in fit_on], y[fit_on], 1 << BITS, c)
        even = np.abs(w[:-1]).sum() / max(1, np.count_nonzero(w[:-1]))
        w[:-1] = (1 - BLEND) * even + BLEND * w[:-1]  # between the plain ratios and the fitted weights
        model = Model((w[:-1] * ratio()).astype(np.float32), float(w[-1]), 1.0, 0.0)
        on = np.flatnonzero(kept) if kept.any() else np.arange(len(y))
        margins = np.array([model.margin(found[i]) for i in on])
        weight = np.where(y[on] > 0, total[1] / max(1, (y[on] > 0).sum()), total[0] / max(1, (y[on] < 0).sum()))
        a, b = _platt(margins, y[on], weight * len(on) / weight.sum())
        some = np.flatnonzero(model.weight)
        buckets = np.concatenate((some, [-1, -1, -1]))
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.concatenate((model.weight[some].astype(float), [model.bias, a, b])))], ["bucket", "value"])

    return run


def fit(rows: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model of (doc_id, text, y) rows, y 0 or 1.

    The class counts come from every row, added up in Spark; 2^BITS of them at
    most reach the driver, and 2^BITS weights. The linear model is fitted in
    one task on ``sample_per_class`` rows of each class, those of the smallest
    xxhash64(doc_id), and its sigmoid on a fifth of these kept out of the fit,
    weighted back to the classes' shares. With a class missing, every score is
    the share of ones (0.5 for no rows).
    """
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "y")
    counts = rows.select("text", "y").mapInArrow(_class_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    total = dict(rows.groupBy("y").count().collect())
    if len(total) < 2:
        share = 0.5 if not total else float(next(iter(total)))
        return Model(np.zeros(1 << BITS), 0.0, 1.0, 30.0 * (2 * share - 1))
    p = np.full((2, 1 << BITS), ALPHA)
    at = counts["bucket"].to_numpy()
    p[0, at] += counts["n0"].to_numpy()
    p[1, at] += counts["n1"].to_numpy()
    ratio = Shared(rows, np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum()))
    del counts, p

    some = None
    for y in (0, 1):  # ids first, so that no text is sorted
        ids = rows.where(F.col("y") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class)
        some = ids if some is None else some.union(ids)
    taken = rows.join(F.broadcast(some), "doc_id").select("doc_id", "y", _indicators("text").alias("found"))
    got = taken.repartition(1).mapInArrow(_solve(ratio, total), "bucket long, value double").toArrow()
    ratio.destroy()
    bucket, value = got["bucket"].to_numpy(), got["value"].to_numpy()
    weight = np.zeros(1 << BITS, np.float32)
    weight[bucket[:-3]] = value[:-3]
    return Model(weight, *map(float, value[-3:]))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _indicators(text: pa.Array) -> pa.Array:
    return pa.array([indicators(t).astype(np.int32) for t in text.to_pylist()], pa.list_(pa.int32()))


def score_udf(docs: DataFrame, model: Model):
    """A column function text -> score from 0 to 1; a null text scores as an empty one."""
    shared = Shared(docs, model)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        m = shared()
        return pa.array([m.score(indicators(t)) for t in text.to_pylist()], pa.float64())

    return lambda text: score(F.coalesce(text, F.lit("")).cast("binary"))


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")
