"""Exact top-k inner-product search: branch and bound over a ball tree per shard, against a shared k-th score."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
#: Vectors of a shard and queries of a block, on average; a task holds one of each.
SHARD_ROWS, BLOCK_ROWS = 8192, 16384
LEAF_ROWS = 64
#: Above this product of norms, sums leave the range in which doubles are exact.
EXACT = 2.0**52


def vectors(df: DataFrame, *more: str) -> DataFrame:
    """(vec_id, v, dim) and the columns named in ``more``: components as floor(256 * x); no rows with a null id, a null vector, or a null or non-finite component.

    Repeated rows stay. An empty vector stays: its inner products are zero.
    """
    x = F.col("embedding")
    inf = float("inf")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == inf))
    some = df.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(x).alias("dim"), *more)


@dataclass
class Tree:
    """Levels of nodes from the root down; a node is a range of the sorted rows. parent: of each node in the level above."""

    x: np.ndarray
    ids: list[np.ndarray]  # of each row its smallest ids, ascending, repeats included
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # start, stop, centre, radius, parent
    single: np.ndarray  # whether all of a row's ids are one
    first: np.ndarray  # its smallest id


def build(x: np.ndarray, ids: np.ndarray, k: int) -> Tree:
    """Equal vectors become one row with the 2k smallest of their ids, k at most of each: no others can be among k, whichever id is the query's own."""
    order = np.lexsort((ids, *x.T[::-1])) if x.shape[1] else np.argsort(ids)
    x, ids = x[order], ids[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]).any(1)))
    at = np.flatnonzero(new)
    owned = [part[np.arange(len(part)) - np.searchsorted(part, part) < k][: 2 * k] for part in np.split(ids, at[1:])]
    x = x[at].astype(float)
    rows = np.arange(len(x))
    spans, levels, parents = [(0, len(x))], [], [0]
    while spans:
        start, stop = np.array(spans).T
        centre = np.stack([x[rows[s:e]].mean(0) for s, e in spans])
        radius = np.array([np.sqrt(((x[rows[s:e]] - c) ** 2).sum(1).max()) for (s, e), c in zip(spans, centre, strict=True)])
        levels.append((start, stop, centre, radius, np.array(parents)))
        spans, parents, done = [], [], True
        for i, (s, e) in enumerate(zip(start, stop, strict=True)):
            if e - s > LEAF_ROWS and radius[i] > 0:
                part = x[rows[s:e]]
                widest = int(np.argmax(part.max(0) - part.min(0)))
                half = (e - s) // 2
                rows[s:e] = rows[s:e][np.argpartition(part[:, widest], half)]
                spans += [(s, s + half), (s + half, e)]
                parents += [i, i]
                done = False
            else:
                spans.append((s, e))
                parents.append(i)
        if done:
            break
    kept = [owned[i] for i in rows]
    return Tree(x[rows], kept, levels, np.array([part[0] == part[-1] for part in kept], bool), np.array([part[0] for part in kept], np.int64))


def search(tree: Tree, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query's place, id, score) of the k best rows of each query that score ``least`` or more.

    Nodes go level by level while their bound q.c + |q| r reaches the current
    k-th score, leaves in the order of their bounds; a bound equal to it stays,
    as a tie may have a smaller id. Every leaf raises the k-th score for the
    leaves after it.
    """
    q = q.astype(float)
    norm = np.sqrt((q * q).sum(1))
    slack = 1e-9 * (norm * np.sqrt((tree.x**2).sum(1).max(initial=0)) + 1)
    alive = np.ones((1, len(q)), bool)
    bound = None
    for _, _, centre, radius, parent in tree.levels:
        bound = centre @ q.T + radius[:, None] * norm + slack
        alive = alive[parent] & (bound >= least)
    start, stop = tree.levels[-1][:2]
    bound = np.where(alive, bound, -np.inf)
    order = np.argsort(-bound, axis=0, kind="stable")
    kth = least.copy()
    best: list[list[tuple[float, int]]] = [[] for _ in q]
    for r in range(len(start)):
        leaf = order[r]
        open_ = np.flatnonzero(bound[leaf, np.arange(len(q))] >= np.maximum(kth, -1e300))
        if not len(open_):
            break
        by = open_[np.argsort(leaf[open_], kind="stable")]
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            s, e = start[leaf[part[0]]], stop[leaf[part[0]]]
            scores = tree.x[s:e] @ q[part].T
            for j, i in enumerate(part):
                good = np.flatnonzero((scores[:, j] >= kth[i]) & ~(tree.single[s:e] & (tree.first[s:e] == own[i])))  # rows of other ids
                if len(good) > k:
                    good = good[scores[good, j] >= np.partition(scores[good, j], -k)[-k]]
                if len(good):
                    found = best[i] + [(-scores[g, j], int(n)) for g in good for n in tree.ids[s + g] if n != own[i]]
                    best[i] = sorted(found)[:k]
                    if len(best[i]) == k:
                        kth[i] = max(kth[i], -best[i][-1][0])
    return [(i, n, -s) for i, found in enumerate(best) for s, n in found]


def _exhaustive(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """For components so large that doubles aren't exact: Python integers, scores kept within 64 bits."""
    out = []
    wide = x.astype(object)
    for i, (v, me) in enumerate(zip(q.astype(object), own, strict=True)):
        scores = [(-max(-(2**63), min(2**63 - 1, int((row * v).sum()))), int(n)) for row, n in zip(wide, ids, strict=True) if n != me]
        out += [(i, n, -s) for s, n in sorted(scores)[:k] if -s >= least[i]]
    return out


def _matrix(column: pa.ChunkedArray, n: int, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(n, dim)


def _task(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not candidates.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        dim = candidates["dim"][0].as_py()
        x, q = _matrix(candidates["v"], candidates.num_rows, dim), _matrix(queries["v"], queries.num_rows, dim)
        ids, own = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        least = queries["least"].to_numpy()
        if dim and math.sqrt((x.astype(float) ** 2).sum(1).max()) * math.sqrt((q.astype(float) ** 2).sum(1).max()) >= EXACT:
            found = _exhaustive(x, ids, q, own, np.nan_to_num(least, neginf=-(2.0**63)), k)
        else:
            found = search(build(x, ids, k), q, own, least, k)
        i, n, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(own[list(i)], pa.int64()), pa.array(n, pa.int64()), pa.array([int(v) for v in s], pa.int64())], names)

    return run


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products with the other vectors, ties to smaller ids.

    is_query: a boolean column over vec_id. Vectors are dealt to shards of
    ``shard_rows`` by a hash of their id, queries to blocks of ``block_rows``;
    a task has a shard and a block. One shard of each dimension is searched
    first, and its k-th score is where the search of all others starts. Vectors
    of another dimension are no candidates; rows with the query's id are its
    own. Fewer candidates than k give fewer rows, an empty table none.
    """
    all_ = vectors(embeddings)
    n, asked = all_.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / block_rows))
    hashed = F.xxhash64("vec_id")
    dealt = all_.withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = all_.where(is_query).select(*[F.col(c).alias(c) for c in all_.columns])  # other attributes than the candidates'
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    key = ["dim", "shard", "block"]
    schema = "query_id long, vec_id long, score long"

    def found(candidates: DataFrame, asked: DataFrame) -> DataFrame:
        return candidates.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_task(k), schema)

    first = cut(found(dealt.where("shard = 0"), queries.withColumn("shard", F.lit(0)).withColumn("least", F.lit(float("-inf")))))
    out = first
    if shards > 1:
        kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
        least = F.coalesce("kth", F.lit(float("-inf"))).alias("least")
        rest = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "dim", "block", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))).alias("shard"), least)
        out = first.union(found(dealt.where("shard > 0"), rest))


    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
