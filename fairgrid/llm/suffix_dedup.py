"""Removal of byte strings that stand earlier in the corpus, by a radix sort of suffixes that stops at the threshold.

Only a suffix's first ``length`` bytes count, so suffixes are ordered by most
significant digits until these are used up or a suffix is alone; groups that
are still equal then are the repeated windows. The first digit is chosen so
that it needn't be sent for each byte: of the K-byte strings in a window that
with the least hash. Equal windows have equal first digits, and neighbouring
windows mostly have the same one at the same place, so a run of windows goes as
one row:

1. first digit: rows are dealt by it; digits that occur once are done;
2. second digit, the whole run's text: of equal runs all but the first go, and
   only the first can hold the first of any window;
3. the runs that are left, by first digit, with their text: passes of eight
   bytes over their windows. Digits that very many runs share are dealt by
   whole windows instead, as aggregates.

Documents lie in blocks by a hash of their id. Blocks get each step's result
by a cogroup, all in one plan whose shuffle of the texts is made once and used
by every step. A block sends one row for a digit or a run, however often it
has it, so copies don't make a key hot.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a removed string at least; of its first digit; of the texts of a block, on average; of texts looked at together; bits of a place there.
LENGTH, K, BLOCK_BYTES, CHUNK, PLACE = 100, 32, 8 << 20, 1 << 17, 17
#: Runs that share a first digit up to which one task compares them: about 9 MB of text and two million windows.
#: Windows of more are dealt one by one.
HOT = 1 << 16
#: What a block is told of: a first digit that repeats, one that very many rows have, a run that isn't the first, windows in a run.
REPEATED, FREQUENT, LATER, WINDOWS = range(4)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        _powers[:] = [np.full(size, x, np.uint64).cumprod(dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0][:n], _powers[1][:n]


def digits(a: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes where its ``k``-byte string of least hash stands (the first of equal ones), and that hash.

    Fewer than 2^PLACE bytes: strings are compared by the other bits of their hash, then by place.
    """
    up, down = _power(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[: len(a) - k + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    least = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    span, most = 1, length - k + 1
    while 2 * span <= most:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if most > span:
        least = np.minimum(least[: len(least) - (most - span)], least[most - span :])
    at = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    return at, h[at]


class Block:
    """A block's documents in order, as bytes end to end, and its runs of windows with one first digit: doc, start (in all bytes), windows, digit."""

    def __init__(self, docs: pa.Table, length: int, k: int):
        texts = [x.encode() for x in docs["text"].to_pylist()]
        ids = docs["doc_id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda n: (ids[n] is not None, ids[n] or 0, texts[n]))
        self.ids, texts = [ids[n] for n in order], [texts[n] for n in order]
        self.length, self.data = length, b"".join(texts)
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))) if texts else np.zeros(1, np.int64)
        self.key = np.array([i if i is not None else -(2**63) for i in self.ids], np.int64)
        fresh = np.concatenate(([True], self.key[1:] != self.key[:-1])) if len(self.key) else np.zeros(0, bool)
        at = np.arange(len(self.key))
        self.copy = at - np.maximum.accumulate(np.where(fresh, at, 0)) if len(at) else at  # rows that repeat an id come one after another
        found = [self._runs(lo, hi, length, k) for lo, hi in self._chunks()]
        self.start, self.windows, self.digit = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1

    def _chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of bytes that hold every window: whole documents together, long ones in pieces that overlap."""
        lo = 0
        for s, e in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            if e - lo > CHUNK:
                if s > lo:
                    yield lo, s
                lo = s
                while e - lo > CHUNK:
                    yield lo, lo + CHUNK
                    lo += CHUNK - self.length + 1
        if lo < len(self.data):
            yield lo, len(self.data)

    def _runs(self, lo: int, hi: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows from lo to hi: windows of one document next to each other with their first digit at one place."""
        if hi - lo < length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        place, d = digits(np.frombuffer(self.data, np.uint8, hi - lo, lo), length, k)
        across = np.zeros(len(d) + 1, np.int32)  # windows over the end of a document
        ends = self.bounds[(self.bounds > lo) & (self.bounds < hi)] - lo
        np.add.at(across, np.minimum(np.maximum(ends - length + 1, 0), len(d)), 1)
        np.add.at(across, np.minimum(ends, len(d)), -1)
        inside = across.cumsum()[: len(d)] == 0
        at = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]))))
        stop = np.append(at[1:], len(d))
        own = inside[at]
        return at[own] + lo, (stop - at)[own], d[at[own]]

    def run_hash(self, rows: np.ndarray) -> np.ndarray:
        data, hashed = memoryview(self.data), xxhash.xxh3_64_intdigest
        stops = self.start[rows] + self.windows[rows] - 1 + self.length
        return np.array([hashed(data[s:e]) for s, e in zip(self.start[rows].tolist(), stops.tolist(), strict=True)], np.uint64)

    def firsts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``rows``, in order: their runs' hashes, and which are the block's first with their digit and text."""
        h = self.run_hash(rows)
        order = np.lexsort((rows, h, self.digit[rows]))
        d, x = self.digit[rows][order], h[order]
        first = np.zeros(len(rows), bool)
        if len(rows):
            first[order[np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])))]] = True
        return h, first

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc, at): what runs are ordered by in the corpus."""
        doc = self.doc[rows]
        return self.key[doc], (self.copy[doc] << 40) + self.start[rows] - self.bounds[doc]


def _told(side: pa.Table, *kinds: int) -> np.ndarray:
    kind = side["kind"].to_numpy()
    return side["a"].to_numpy()[np.isin(kind, kinds)]


def _table(schema: str, *columns) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, pa.int64()) for c in columns], names)


DIGITS = "digit long, block long, n long"
RUNS = "digit long, run long, doc long, at long, block long, a long"
TEXTS = "digit long, frequent boolean, doc long, at long, block long, a long, text binary"
SIDE = "block long, kind int, a long, runs array<int>"


def _first_digits(length: int, k: int):
    def run(docs: pa.Table) -> pa.Table:
        b = Block(docs, length, k)
        d, n = np.unique(b.digit, return_counts=True)
        return _table(DIGITS, d.view(np.int64), np.full(len(d), docs["block"][0].as_py()), n)

    return run


def _side(block, kind: int, a) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.full(n, kind), pa.int32()) if np.isscalar(kind) else pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], ["block", "kind", "a", "runs"])


def _runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """For sorted batches, whole groups of equal keys at a time: columns, group numbers, group starts. Small groups come many at once."""
    held: list[pa.RecordBatch] = []

    def give(t: pa.Table):
        cols = {n: t[n].combine_chunks() for n in t.column_names}
        new = np.concatenate(([True], np.any([(x := cols[c].to_numpy())[1:] != x[:-1] for c in keys], axis=0)))
        return cols, np.cumsum(new) - 1, np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch.column(c).to_numpy() for c in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in x], axis=0)) + 1
        same = bool(held) and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in keys)
        if not same and held:
            yield give(pa.Table.from_batches(held))
            held = []
        if len(change):
            cut = int(change[-1])
            yield give(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield give(pa.Table.from_batches(held))


def _repeated_digits(hot: int):
    """Sorted (digit, block, n) to what blocks are told of the digits that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, group, _ in _runs_of(batches, ["digit"]):
            total = np.bincount(group, cols["n"].to_numpy())[group]
            more = total > 1
            yield _side(cols["block"].to_numpy()[more], np.where(total[more] > hot, FREQUENT, REPEATED), cols["digit"].to_numpy()[more])

    return run


def _repeated_runs(length: int, k: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        b = Block(docs, length, k)
        rows = np.flatnonzero(np.isin(b.digit.view(np.int64), _told(side, REPEATED, FREQUENT)))
        h, first = b.firsts(rows)
        rows, h = rows[first], h[first]
        doc, at = b.place(rows)
        return _table(RUNS, b.digit[rows].view(np.int64), h.view(np.int64), doc, at, np.full(len(rows), docs["block"][0].as_py() if docs.num_rows else 0), rows)

    return run


def _later_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (digit, run, doc, at): all but the first of equal ones."""
    for cols, _, start in _runs_of(batches, ["digit", "run"]):
        later = np.ones(len(cols["a"]), bool)
        later[start] = False
        yield _side(cols["block"].to_numpy()[later], LATER, cols["a"].to_numpy()[later])


def _open_runs(length: int, k: int):
    """The texts of runs that are the first of their kind and whose digit others have too."""

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        b = Block(docs, length, k)
        d = b.digit.view(np.int64)
        rows = np.flatnonzero(np.isin(d, _told(side, REPEATED, FREQUENT)))
        _, first = b.firsts(rows)
        rows = np.setdiff1d(rows[first], _told(side, LATER), assume_unique=True)
        doc, at = b.place(rows)
        stops = b.start[rows] + b.windows[rows] - 1 + length
        texts = pa.array([b.data[s:e] for s, e in zip(b.start[rows].tolist(), stops.tolist(), strict=True)], pa.binary())
        frequent = pa.array(np.isin(d[rows], _told(side, FREQUENT)), pa.bool_())
        return _table(TEXTS, d[rows], frequent, doc, at, np.full(len(rows), docs["block"][0].as_py() if docs.num_rows else 0), rows, texts)

    return run


def equal_windows(data: np.ndarray, window: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (by number) that have an equal one in their group, and the number of their class: digits of eight bytes, the most significant first.

    After each digit the windows that are alone are left out.
    """
    alive = np.arange(len(window))
    eight = np.lib.stride_tricks.sliding_window_view(np.pad(data, (0, 8)), 8)
    offsets = [*range(0, length - 7, 8), *([max(length - 8, 0)] if length % 8 else [])]
    n, at = np.unique(group, return_inverse=True)
    keep = np.bincount(at, minlength=len(n))[at] > 1
    alive, group = alive[keep], at[keep]
    for o in offsets:
        if not len(alive):
            break
        digit = np.ascontiguousarray(eight[window[alive] + o]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        group = np.cumsum(new) - 1
        keep = np.bincount(group)[group] > 1
        alive, group = alive[keep], group[keep]
    return alive, group


def _later_windows(length: int):
    """Sorted texts of runs to the windows in them that stand in an earlier run too, or earlier in their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, group, _ in _runs_of((b.filter(pa.compute.invert(b.column("frequent"))) for b in batches), ["digit"]):
            texts = cols["text"].to_pylist()
            size = np.array([len(t) for t in texts])
            base, windows = np.cumsum(size) - size, size - length + 1
            row = np.repeat(np.arange(len(texts)), windows)
            off = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            which, same = equal_windows(np.frombuffer(b"".join(texts), np.uint8), base[row] + off, group[row], length)
            if not len(which):
                continue
            doc, at = cols["doc"].to_numpy()[row[which]], cols["at"].to_numpy()[row[which]] + off[which]
            order = np.lexsort((at, doc, same))
            later = np.ones(len(which), bool)
            later[order[np.concatenate(([True], same[order][1:] != same[order][:-1]))]] = False
            which = np.sort(which[later])
            r, o = row[which], off[which]
            start = np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1))) if len(r) else np.zeros(0, bool)
            lo, hi = o[start], o[np.append(np.flatnonzero(start)[1:] - 1, len(o) - 1)] + 1 if len(o) else o
            rows, n = np.unique(r[start], return_counts=True)
            flat = np.empty(2 * len(lo), np.int32)
            flat[::2], flat[1::2] = lo, hi
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], 2 * np.cumsum(n))), pa.int32()), pa.array(flat))
            kind = pa.array(np.full(len(rows), WINDOWS), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(cols["block"].to_numpy()[rows]), kind, pa.array(cols["a"].to_numpy()[rows]), runs], ["block", "kind", "a", "runs"])

    return run


HASHED = "x long, y long, doc long, at long, block long, a long, off int"


def _hashed_windows(length: int):
    """Each window of the runs with a very frequent digit, as 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in np.flatnonzero(batch.column("frequent").to_numpy(zero_copy_only=False)):
                row, text = batch.slice(int(n), 1), memoryview(batch.column("text")[int(n)].as_py())
                for lo in range(0, len(text) - length + 1, CHUNK):
                    off = np.arange(lo, min(lo + CHUNK, len(text) - length + 1))
                    hashed = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[o : o + length]) for o in off.tolist()), np.int64).reshape(-1, 2)
                    same = lambda c, off=off, row=row: np.full(len(off), row.column(c)[0].as_py())
                    cols = [hashed[:, 0].copy(), hashed[:, 1].copy(), same("doc"), same("at") + off, same("block"), same("a"), off.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["x", "y", "doc", "at", "block", "a", "off"])

    return run


def _frequent_windows(texts: DataFrame, length: int) -> DataFrame:
    """As _later_windows, for runs with a very frequent digit: the first place of each window by an aggregate."""
    each = texts.mapInArrow(_hashed_windows(length), HASHED)
    first = each.groupBy("x", "y").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("x", "y", "first")
    later = each.join(first, ["x", "y"]).where(F.struct("doc", "at") > F.col("first"))
    step = (F.col("off") - F.row_number().over(Window.partitionBy("block", "a").orderBy("off"))).alias("step")
    spans = later.select("block", "a", "off", step).groupBy("block", "a", "step").agg(F.min("off").alias("lo"), (F.max("off") + 1).alias("hi"))
    runs = F.flatten(F.collect_list(F.array("lo", "hi")))  # of the windows of one run
    return spans.groupBy("block", "a").agg(runs.alias("runs")).select("block", F.lit(WINDOWS).alias("kind"), "a", "runs")


def _remove(length: int, k: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        b = Block(docs, length, k)
        here, at, n = np.unique(b.digit, return_inverse=True, return_counts=True)
        rows = np.flatnonzero(n[at] > 1) if len(here) else np.zeros(0, np.int64)
        _, first = b.firsts(rows)
        rows = np.concatenate((rows[~first], _told(side, LATER)))
        lo, hi = b.start[rows], b.start[rows] + b.windows[rows] - 1
        listed = side.filter(pa.compute.equal(side["kind"], WINDOWS))
        if listed.num_rows:
            flat = listed["runs"].combine_chunks()
            flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
            base = np.repeat(b.start[listed["a"].to_numpy()], np.diff(flat.offsets.to_numpy()) // 2)
            ends = flat.flatten().to_numpy()
            lo, hi = np.concatenate((lo, base + ends[::2])), np.concatenate((hi, base + ends[1::2] - 1))
        depth = np.zeros(len(b.data) + 1, np.int64)
        np.add.at(depth, lo, 1)
        np.add.at(depth, hi + length, -1)
        gone = depth.cumsum()[:-1] > 0
        left = np.frombuffer(b.data, np.uint8)
        removed, spans, kept = [], [], []
        for s, e in zip(b.bounds[:-1].tolist(), b.bounds[1:].tolist(), strict=True):
            g = gone[s:e]
            removed.append(int(g.sum()))
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            kept.append(hashlib.sha256(left[s:e][~g].tobytes() if removed[-1] else b.data[s:e]).hexdigest())
        return pa.table([pa.array(b.ids, docs.schema.field("doc_id").type), pa.array(np.diff(b.bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int | None = None, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every text after the bytes of strings that start earlier are taken out.

    A byte goes if any ``length``-byte string over it also starts earlier: in a
    document with a smaller id, or before in the same one. Strings don't cross
    documents and are judged on the texts as they came. Null texts are empty;
    texts shorter than ``length`` stay whole. Rows that repeat an id stand in
    the order of their texts, and rows without an id before all others, as if
    they had one id: they share a block. An empty table gives an empty one;
    other columns of ``docs`` aren't read.
    """
    k = min(K, length) if k is None else k
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    texts = docs.select(F.pmod(F.xxhash64(doc_id), F.lit(blocks)).alias("block"), doc_id, F.coalesce("text", F.lit("")).alias("text"))
    own = texts.groupBy("block")
    dealt = own.applyInArrow(_first_digits(length, k), DIGITS).repartition("digit").sortWithinPartitions("digit")
    digits_ = dealt.mapInArrow(_repeated_digits(hot), SIDE)
    runs = own.cogroup(digits_.groupBy("block")).applyInArrow(_repeated_runs(length, k), RUNS)
    later = runs.repartition("digit", "run").sortWithinPartitions("digit", "run", "doc", "at").mapInArrow(_later_runs, SIDE)
    open_ = own.cogroup(digits_.union(later).groupBy("block")).applyInArrow(_open_runs(length, k), TEXTS)
    # one shuffle for both kinds; where they are told apart in SQL, the filter would go below it and make two
    open_ = open_.repartition(F.when(F.col("frequent"), F.xxhash64("doc", "at")).otherwise(F.col("digit")))
    some = open_.sortWithinPartitions("digit").mapInArrow(_later_windows(length), SIDE)
    told = later.union(some).union(_frequent_windows(open_, length))
    return own.cogroup(told.groupBy("block")).applyInArrow(_remove(length, k), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
