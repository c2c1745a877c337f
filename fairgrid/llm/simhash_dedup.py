"""Near-duplicate documents by SimHash: a binary-trie self-join within a Hamming radius."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, cut, fresh, small
from .graph import connected_components

RADIUS = 2
SHINGLE = 3
#: Fingerprints below one top node of the trie, on average.
NODE_ROWS = 1 << 14
#: Node pairs that are open at once in a task.
FRONTIER = 1 << 20
#: A node pair with so few fingerprint pairs is compared outright.
LEAF_PAIRS = 16


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text: a bit is set if over half of the shingles' XXH64 have it."""
    import xxhash

    words = data.translate(LOWER).split()
    if not words:
        return 0
    lists = [words[i:] for i in range(shingle)] if len(words) > shingle else [[b" ".join(words)]]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*lists, strict=False)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t or b"") for t in text.to_pylist()], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document; a null text counts as empty."""
    return docs.select("doc_id", _fingerprints(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("fp"))


class _Forest:
    """Union-find over nodes, by whole arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(q := self.parent[self.parent], self.parent):
            self.parent = q
        return self.parent

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.roots()
            a, b = p[a], p[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


class _Near(_Forest):
    """Links places whose fingerprints are within the radius."""

    def __init__(self, fp: np.ndarray, radius: int):
        super().__init__(len(fp))
        self.fp, self.radius = fp, radius

    def meet(self, i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.radius
        self.link(i[near], j[near])


def _leaves(forest: _Forest, a0, a1, b0, b1) -> None:
    width = b1 - b0
    size = (a1 - a0) * width
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    i, j = a0[which] + k // width[which], b0[which] + k % width[which]
    forest.meet(i, j)


def trie_links(fp: np.ndarray, a0, a1, b0, b1, wrong, level: int, radius: int, forest: _Forest) -> None:
    """Traverse node pairs of the trie over ``fp`` together, down from ``level``.

    A node is a range [x0, x1) of fp that shares its first ``level`` bits, in
    ascending order; a pair of a node with itself has equal ranges. ``wrong`` is
    the differing bits so far: a child pair over the radius is pruned. Places
    that may be within it go to forest.meet(). Open pairs are kept depth first,
    in pieces of FRONTIER at most.
    """
    todo = [(level, a0, a1, b0, b1, wrong)]
    while todo:
        level, *pair = todo.pop()
        if len(pair[0]) > FRONTIER:
            half = len(pair[0]) // 2
            todo += [(level, *(x[:half] for x in pair)), (level, *(x[half:] for x in pair))]
            continue
        a0, a1, b0, b1, wrong = pair
        same = a0 == b0
        few = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if level == 64:  # equal paths: what is left is within the radius
            few[:] = True
        if few.any():
            _leaves(forest, a0[few], a1[few], b0[few], b1[few])
        go = ~few
        a0, a1, b0, b1, wrong, same = (x[go] for x in (a0, a1, b0, b1, wrong, same))
        if not len(a0):
            continue
        bit = ((fp >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)
        ones = np.concatenate(([0], np.cumsum(bit)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        kids = [
            (a0, am, b0, bm, wrong, None),
            (am, a1, bm, b1, wrong, None),
            (a0, am, bm, b1, wrong + 1, None),
            (am, a1, b0, bm, wrong + 1, ~same),  # of a node with itself, the mirror of the one above
        ]
        out = []
        for c0, c1, d0, d1, w, keep in kids:
            ok = (c1 > c0) & (d1 > d0) & (w <= radius)
            ok &= ~((c0 == d0) & (c1 - c0 == 1))
            if keep is not None:
                ok &= keep
            out.append([x[ok] for x in (c0, c1, d0, d1, w)])
        joined = [np.concatenate(x) for x in zip(*out, strict=True)]
        if len(joined[0]):
            todo.append((level + 1, *joined))


def _task(radius: int):
    """For one Spark partition: whole groups of (kind, depth, tag, key, fp); gives edges of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        kind, depth, tag, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, key, tag, depth, kind))
        kind, depth, tag, key, fp = (x[order] for x in (kind, depth, tag, key, fp))
        new = np.zeros(len(fp), bool)
        new[0] = True
        for x in (kind, depth, tag, key):
            new[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(fp)]))
        forest = _Near(fp, radius)
        for k, d in {*zip(kind[first].tolist(), depth[first].tolist(), strict=True)}:
            mine = (kind[first] == k) & (depth[first] == d) & (last - first > 1)
            lo, hi = first[mine], last[mine]
            zero = np.zeros(len(lo), np.int64)
            if k == SELF:
                trie_links(fp, lo, hi, lo, hi, zero, d, radius, forest)
            elif k == BELOW:
                trie_links(fp, lo, hi, lo, hi, zero, 0, radius, forest)
            else:
                step = np.concatenate(([0], np.cumsum((fp[1:] ^ fp[:-1]) >> np.uint64(64 - d) != 0)))
                mid = np.searchsorted(step, step[lo], side="right")
                two = mid < hi
                trie_links(fp, lo[two], mid[two], mid[two], hi[two], zero[two] + 1, d, radius, forest)
        p = forest.roots()
        linked = np.flatnonzero(p != np.arange(len(p)))
        signed = fp.view(np.int64)
        for at in range(0, len(linked), 1 << 16):
            some = linked[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(signed[some]), pa.array(signed[p[some]])], ["u", "v"])

    return run


#: What a group of fingerprints is: a node with itself; two nodes that differ in one bit (tag); all that are equal below a depth.
SELF, PAIR, BELOW = 0, 1, 2
#: Bits by which a group that is too large is taken apart at a time.
DEEPER = 6


def _group(kind: int, depth: int, tag, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), F.lit(tag).cast("int").alias("tag"), key.cast("long").alias("key"))


def _dealt(rows: DataFrame, depth: int, since: int, radius: int) -> DataFrame:
    """The groups of fingerprints of a node, told apart by the bits from ``since`` to ``depth``."""
    top = F.shiftrightunsigned("fp", 64 - depth)
    cleared = lambda b: top.bitwiseAND(F.lit(((1 << depth) - 1) & ~(1 << b)))
    groups = [_group(SELF, depth, -1, top)]
    if radius >= 1:
        groups += [_group(PAIR, depth, depth - 1 - b, cleared(b)) for b in range(depth - since)]
    if radius >= 2:
        groups.append(_group(BELOW, depth, -1, F.col("fp").bitwiseAND(F.lit((1 << (64 - depth)) - 1))))
    return rows.select(F.explode(F.array(*groups)).alias("g"), "fp").select("g.*", "fp")


def _dealt_pairs(rows: DataFrame, depth: int, radius: int) -> DataFrame:
    """The same for two nodes that differ in the bit ``tag``: one error is left, or with none the rest below is equal."""
    bit = F.expr(f"shiftleft(1L, {depth - 1} - tag)")
    groups = [F.struct(F.lit(PAIR).alias("kind"), F.lit(depth).alias("depth"), F.col("tag").alias("tag"), F.shiftrightunsigned("fp", 64 - depth).bitwiseAND(F.bitwise_not(bit)).alias("key"))]
    if radius >= 2:
        groups.append(_group(BELOW, depth, -1, F.col("fp").bitwiseAND(F.lit((1 << (64 - depth)) - 1))))
    return rows.select(F.explode(F.array(*groups)).alias("g"), "fp").select("g.*", "fp")


def hamming_links(fps: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) that connect whatever lies within ``radius`` (0 to 2) bits.

    The trie's top is laid over the cluster: nodes at a depth that follows
    their count, so that a node holds ``node_rows`` fingerprints on average
    whatever the input. Pairs of top nodes with error budget left go to a task
    by themselves: a node with itself, and each two nodes that differ in one
    bit. Two nodes that differ in ``radius`` bits have no budget left below, so
    their fingerprints can only meet in groups that are equal below the top. A
    fingerprint is dealt depth + 2 times, not once per pair of nodes. Groups
    that many near copies make larger than four nodes are taken apart in the
    same way by their next bits, again and again. A task gives a spanning
    forest of its links, never all pairs of a dense group.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    n = fps.count()
    depth = max(1, min(24, math.ceil(math.log2(max(2, n / node_rows)))))
    rows = _dealt(fps, depth, 0, radius)
    group = ["kind", "depth", "tag", "key"]
    while depth + DEEPER < 60:
        large = rows.where((F.col("depth") == depth) & (F.col("kind") != BELOW)).groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > 4 * node_rows)
        large = cut(large.select(*group))
        if not large.take(1):
            break
        large = small(large)
        apart = cut(rows.join(large, group, "left_semi"))
        rows = rows.join(large, group, "left_anti")
        was, depth = depth, depth + DEEPER
        both = apart.where(F.col("kind") == PAIR)
        rows = rows.union(_dealt(apart.where(F.col("kind") == SELF), depth, was, radius)).union(_dealt_pairs(both, depth, radius))
    return rows.repartition(*group).mapInArrow(_task(radius), "u long, v long")


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id, n_class (documents of the same fingerprint).

    component_id is the smallest doc_id reachable over links of ``radius`` bits,
    its own included. Null and empty texts have fingerprint zero and link like
    any other. Null ids count for nothing in a minimum, so a component of them
    alone has a null one. Repeated rows each keep a row. An empty table gives
    an empty one.
    """
    rows = cut(fingerprints(docs))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_class")))
    roots = cut(connected_components(hamming_links(classes.select("fp"), radius)))
    linked = classes.join(small(roots).withColumnRenamed("node", "fp"), "fp", "left")
    linked = linked.withColumn("root", F.coalesce("root", "fp"))
    # only classes with a link have more than themselves to look at
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(whole, "root").select("fp", "component_id", "n_class")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "n_class")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group: the one of the smallest id, then the smallest text.

    Rows equal in id and text count as one. All columns of ``docs`` stay as they are.
    """
    key, tie = fresh(docs, "group_key"), fresh(docs, "tie")
    fp = docs.withColumn(key, _fingerprints(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = cut(fp.select(F.col("doc_id"), F.col(key).alias("fp"), F.xxhash64("text").alias("tie")))
    # the first by (id, text) of each fingerprint, nulls last, then of each component
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tie"))
    classes = cut(rows.groupBy("fp").agg(F.min(order).alias("first")))
    roots = cut(connected_components(hamming_links(classes.select("fp"), radius)))
    linked = classes.join(small(roots).withColumnRenamed("node", "fp"), "fp", "left")
    kept = cut(linked.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(key), F.col("first.tie").alias(tie)))
    named = docs.withColumn(tie, F.xxhash64("text"))
    first = kept.select(F.col(key).alias("kept_id"), F.col(tie).alias("kept_tie"))
    same = lambda df, i, t: df[i].eqNullSafe(first["kept_id"]) & (df[t] == first["kept_tie"])
    out = named.join(small(first), same(named, "doc_id", tie), "left_semi")
    if rows.join(small(first), same(rows, "doc_id", "tie"), "left_semi").count() > first.count():
        out = out.dropDuplicates(["doc_id", tie])  # only where rows repeat: this shuffles texts
    return out.drop(tie)
