"""Language-model scores by context-tree weighting over bytes, each byte as eight binary decisions.

Every node of a byte's decision tree has a tree of contexts: the bytes before,
closest first, down to ``depth``. Counts come from all training texts. A
context's Krichevsky-Trofimov estimate is mixed half and half with what its
longer contexts say together, bottom-up; the weights of that mixture then give
the probability of a byte by mixing the estimates of all depths on its path.
Once the counts are there, the order of the texts doesn't matter, so all of it
is aggregation: counts by (context, byte), trees by the two closest bytes (at
most 256^(depth-1) rows each), the top of the tree from sums.

No model is broadcast: each input block gets the entries for the words and
byte strings that occur in it by a join, and is scored with these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut

DEPTH = 3
#: Follows each text's last byte; it occurs in no UTF-8 text. Bytes before the first one count as zero.
END = 0xFF
#: Bytes of text whose strings are counted at once in a task.
CHUNK = 8 << 20
CHANGED = "a block's texts changed between two readings; leave out from_files"


def byte_strings(data: bytes, depth: int = DEPTH) -> np.ndarray:
    """For each byte of a text and its end: the bytes before it, closest first, then the byte, as one number."""
    a = np.frombuffer(bytes(depth) + data + bytes([END]), np.uint8).astype(np.int64)
    n = len(data) + 1
    out = a[depth:].copy()
    for back in range(1, depth + 1):
        out |= a[depth - back : depth - back + n] << (8 * (depth + 1 - back))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0, to about 1e-11."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1)), shift)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def mixed(log_e: np.ndarray, log_kids: np.ndarray) -> np.ndarray:
    return np.logaddexp(log_e, log_kids) - np.log(2)


def trees(strings: np.ndarray, n: np.ndarray, depth: int, top: int) -> Iterator[tuple]:
    """For each of the eight bits the levels of its context trees, from ``depth`` up to ``top`` bytes.

    strings: distinct byte strings with training counts n (0 allowed), holding
    every string of the contexts at ``top``. A level: (keys, the node of each
    string, zeros, ones, log of the estimate, log of the mixture).
    """
    byte = strings & 255
    for bit in range(8):
        node = (1 << bit) | (byte >> (8 - bit))
        one = (byte >> (7 - bit)) & 1
        levels, below = [], None
        for d in range(depth, top - 1, -1):
            context = strings >> (8 * (depth + 1 - d))
            keys, at = np.unique((context << 8) | node, return_inverse=True)
            ones = np.bincount(at, weights=n * one, minlength=len(keys))
            zeros = np.bincount(at, weights=n * (1 - one), minlength=len(keys))
            log_e = log_kt(zeros, ones)
            if below is None:
                log_w = log_e
            else:
                up = np.searchsorted(keys, (below[0] >> 16 << 8) | (below[0] & 255))
                log_w = mixed(log_e, np.bincount(up, weights=below[5], minlength=len(keys)))
            below = (keys, at, zeros, ones, log_e, log_w)
            levels.append(below)
        yield bit, node, one, levels


def step(p: np.ndarray, one: np.ndarray, zeros, ones, log_e, log_w) -> np.ndarray:
    """The probability at a node from that of its child ``p``: the node's own estimate has the share of the mixture that stops there."""
    own = (np.where(one == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
    w = np.exp(np.minimum(0.0, log_e - np.log(2) - log_w))
    return w * own + (1 - w) * p


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _lower_sums(depth: int):
    """Whole two-byte contexts of (string, n): what their one-byte parents need, by (context, node)."""

    def run(batches):
        strings, n = _rows(batches)
        for _, _, _, levels in trees(strings, n, depth, 2) if len(strings) else ():
            keys, _, zeros, ones, _, log_w = levels[-1]
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 16 << 8 | keys & 255), pa.array(zeros), pa.array(ones), pa.array(log_w)], ["key", "zeros", "ones", "log_kids"])

    return run


def _log_probabilities(depth: int, shared):
    """(string, n) to (string, log10 of the last byte's probability), given the top of the tree."""

    def run(batches):
        strings, n = _rows(batches)
        if not len(strings):
            return
        keys1, z1, o1, e1, w1, z0, o0, e0, w0 = shared.value
        first = strings >> (8 * depth)
        total = np.zeros(len(strings))
        for _, node, one, levels in trees(strings, n, depth, 2):
            p = np.full(len(strings), 0.5)
            for d, (_, at, zeros, ones, log_e, log_w) in enumerate(levels):
                here = (zeros + ones)[at] > 0
                own = (np.where(one == 1, ones[at], zeros[at]) + 0.5) / ((zeros + ones)[at] + 1)
                p = np.where(here, own if d == 0 else step(p, one, zeros[at], ones[at], log_e[at], log_w[at]), 0.5)
            i = np.minimum(np.searchsorted(keys1, first << 8 | node), len(keys1) - 1)
            here = keys1[i] == (first << 8 | node)
            p = np.where(here, step(p, one, z1[i], o1[i], e1[i], w1[i]), 0.5)
            p = np.where((z0 + o0)[node] > 0, step(p, one, z0[node], o0[node], e0[node], w0[node]), 0.5)
            total += np.log10(p)
        yield pa.RecordBatch.from_arrays([pa.array(strings), pa.array(total)], ["string", "log10_p"])

    return run


def fit(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Distinct (string, n) to (string, log10_p). Strings of count 0 get the probability that the others imply.

    65,280 rows at most come to the driver: the tree's nodes of one byte.
    """
    if depth < 2:
        raise ValueError("depth must be 2 or more")
    dealt = counts.repartition(F.shiftright("string", 8 * (depth - 1)))
    sums = dealt.mapInArrow(_lower_sums(depth), "key long, zeros double, ones double, log_kids double").groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_kids").alias("log_kids"))
    got = sums.where("zeros + ones > 0").toArrow().sort_by("key")
    keys, z, o, kids = (got[c].to_numpy() for c in got.column_names)
    e = log_kt(z, o)
    w = mixed(e, kids)
    if not len(keys):
        keys, z, o, e, w = (np.zeros(1, t) for t in (np.int64, float, float, float, float))
        keys = keys - 1
    node = np.maximum(keys & 255, 0)
    real = keys >= 0
    z0, o0, k0 = (np.bincount(node[real], weights=x[real], minlength=256) for x in (z, o, w))
    e0 = log_kt(z0, o0)
    top = (keys, z, o, e, w, z0, o0, e0, mixed(e0, k0))
    shared = counts.sparkSession.sparkContext.broadcast(top)
    return dealt.mapInArrow(_log_probabilities(depth, shared), "string long, log10_p double")


def _count(depth: int):
    """(block, text, learn) of one input block to its distinct words and byte strings with their training counts."""

    def run(batches):
        words: tuple[Counter, Counter] = (Counter(), Counter())
        strings: list[tuple[np.ndarray, np.ndarray]] = []
        block, size, open_ = None, 0, ([], [])

        def close():
            for learn in (0, 1):
                if open_[learn]:
                    s, n = np.unique(np.concatenate(open_[learn]), return_counts=True)
                    strings.append((s, n * learn))
                    open_[learn].clear()
            if len(strings) > 8:
                merge()

        def merge():
            s, at = np.unique(np.concatenate([x for x, _ in strings]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([y for _, y in strings]), minlength=len(s)).astype(np.int64)
            strings[:] = [(s, n)]

        for b in batches:
            for at, data, learn in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = at
                data = data.translate(LOWER)
                words[learn].update(data.split())
                open_[learn].append(byte_strings(data, depth))
                size += len(data)
                if size >= CHUNK:
                    close()
                    size = 0
        if block is None:
            return
        close()
        merge()
        keys = list({*words[0], *words[1]})
        for i in range(0, len(keys), 1 << 15):
            some = keys[i : i + (1 << 15)]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), pa.array(some, pa.binary()), pa.nulls(n, pa.int64()), pa.array([words[1][w] for w in some], pa.int64())], ["block", "word", "string", "n"])
        s, n = strings[0]
        for i in range(0, len(s), 1 << 16):
            k = len(s[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(s[i : i + k]), pa.array(n[i : i + k])], ["block", "word", "string", "n"])

    return run


def _score(depth: int, shared):
    import math

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        tokens, ends, distinct = shared.value
        whole = tokens + distinct + 1
        w = known.filter(known["word"].is_valid())
        logs = {k: math.log10((c + 1) / whole) for k, c in zip(w["word"].to_pylist(), w["value"].to_pylist(), strict=True)}
        never = math.log10(1 / whole)
        end = math.log10((ends + 1) / whole)
        s = known.filter(known["string"].is_valid()).sort_by("string")
        keys, p = s["string"].to_numpy(), s["value"].to_numpy()
        rows = []
        for data in docs["text"].to_pylist():
            data = data.translate(LOWER)
            try:
                found = np.fromiter(map(logs.__getitem__, words := data.split()), float, len(words))
            except KeyError:
                raise RuntimeError(CHANGED) from None
            x = byte_strings(data, depth)
            at = np.searchsorted(keys, x)
            if at.max() >= len(keys) or (keys[at] != x).any():
                raise RuntimeError(CHANGED)
            rows.append((len(words) + 1, int((found > never).sum()) + (ends > 0), float(found.sum()) + end, float(p[at].sum())))
        cols = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        out = [docs["doc_id"], docs["held_out"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
        out.append(pa.array([tokens] * len(rows), pa.int64()))
        return pa.table(out, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens"])

    return run


def score_documents(docs: DataFrame, held_out: Column, depth: int = DEPTH, from_files: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean column of ``docs``; where it is null the text isn't
    learned from and the result says false. A-Z are lower-cased. score is log10
    of the text's probability, its end included; base_score that of add-one
    word frequencies. A null text counts as empty: one token, its end. Repeated
    rows count and score as often as they stand there.

    Texts are read twice, in the same blocks. ``from_files`` says that ``docs``
    is a plain scan of files, which gives a partition the same rows each time;
    anything else is kept in the shared folder first. A file that changes
    between the two readings raises an error.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(~held_out, F.lit(False)).cast("int").alias("learn"))
    spark = docs.sparkSession
    if not from_files:
        rows = cut(rows)
    elif spark.conf.get("spark.sql.files.minPartitionNum", None) is None:  # else lost executors could change how files are split
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    rows = rows.withColumn("block", F.spark_partition_id())
    each = cut(rows.select("block", "text", "learn").mapInArrow(_count(depth), "block int, word binary, string long, n long"))
    words = each.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    strings = each.where("string is not null").groupBy("string").agg(F.sum("n").alias("n"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    ends = rows.where("learn = 1").count()
    shared = spark.sparkContext.broadcast((total[0] + ends, ends, total[1] + (ends > 0)))
    by_word = each.where("word is not null").select("block", "word").join(words, "word").select("block", "word", F.lit(None).cast("long").alias("string"), F.col("n").cast("double").alias("value"))
    by_string = each.where("string is not null").select("block", "string").join(fit(strings, depth), "string").select("block", F.lit(None).cast("binary").alias("word"), "string", F.col("log10_p").alias("value"))
    known = by_word.union(by_string)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long"
    texts = rows.select("block", F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    out = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score(depth, shared), schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
