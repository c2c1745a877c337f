"""Hard negatives from blocks along a Hilbert curve, chosen by interval bounds on inner products.

Vectors are written once as Parquet blocks: by dimension and label, then along
a Hilbert curve over the components that vary most, so that a block is narrow
in these. Its zone map has the least and largest value of every component, and
of its labels. The inner product of an anchor q with any vector of a block lies
between the sums of min(q lo, q hi) and max(q lo, q hi). Anchors go in teams of
neighbours on the curve; a team reads a block if any of its anchors' score
windows meets the interval, and in that task the block is skipped for each
anchor whose windows don't.

Each search has two rounds: a block of an anchor's own (for positives the one
it lies in, for negatives that of the largest bound) gives the k-th score of
each window, and only blocks that can reach this are read after that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balltree import EXACT, vectors
from .common import stored

#: Vectors of a block, anchors of a team, and zone maps that meet a team in one task, on average.
BLOCK_ROWS, TEAM_ROWS, ZONES = 4096, 2048, 4096
#: Components on the curve, and bits of each.
AXES, BITS = 8, 7
LEAST, MOST = -(2**63), 2**63 - 1


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the rows of non-negative integers below 2^bits; bits times components is 63 at most.

    Turns and mirrors each level's cube as the levels above ask for, then takes
    the cubes' order from a Gray code.
    """
    x = x.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in x:
            on = (axis >> level & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(on, low, swap)
            axis ^= swap
    for n in range(1, len(x)):
        x[n] ^= x[n - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> level & 1
    return key


def _curve(batches):
    for b in batches:
        cells = b.column("cells").flatten().to_numpy().reshape(b.num_rows, -1)
        yield b.drop_columns(["cells"]).append_column("curve", pa.array(hilbert(cells, BITS), pa.int64()))


def write_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, label, v, dim, anchor) to stored rows with ``block``, whose order is that of dimension, label and curve."""
    each = rows.select(F.posexplode("v").alias("pos", "x"))
    spread = each.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev")).orderBy(F.desc("dev"), "pos").limit(AXES).collect()
    half = 1 << (BITS - 1)
    cells = [F.least(F.greatest(F.floor((F.coalesce(F.get("v", r.pos).cast("double"), F.lit(0.0)) - r.mean) / (r.dev or 1.0) * (half / 4)) + half, F.lit(0)), F.lit(2 * half - 1)).cast("long") for r in spread]
    placed = rows.withColumn("cells", F.array(*(cells or [F.lit(0).cast("long")])))
    schema = "vec_id long, label long, v array<long>, dim int, anchor boolean, curve long"
    placed = placed.select("vec_id", "label", "v", "dim", "anchor", "cells").mapInArrow(_curve, schema)
    blocks = max(1, math.ceil(rows.count() / block_rows))
    order = ["dim", "label", "curve", "vec_id"]
    dealt = placed.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())
    return stored(dealt, "vector-blocks")


ZONE = "dim int, block int, label_lo long, label_hi long, lo array<long>, hi array<long>"


def _matrix(t: pa.Table, column: str = "v") -> np.ndarray:
    flat = t[column].combine_chunks().flatten().to_numpy()
    return flat.reshape(t.num_rows, -1) if t.num_rows and len(flat) else np.zeros((t.num_rows, 0), np.int64)


def _zones(batches):
    for b in batches:
        t = pa.Table.from_batches([b])
        out = []
        for dim, block in sorted(set(zip(b.column("dim").to_pylist(), b.column("block").to_pylist(), strict=True))):
            own = t.filter(pa.compute.and_(pa.compute.equal(t["dim"], dim), pa.compute.equal(t["block"], block)))
            x, labels = _matrix(own), own["label"].to_numpy()
            out.append((dim, block, int(labels.min()), int(labels.max()), x.min(0).tolist(), x.max(0).tolist()))
        names, kinds = ["dim", "block", "label_lo", "label_hi", "lo", "hi"], [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def zone_maps(blocks: DataFrame) -> DataFrame:
    """One row for each dimension and block: the least and largest label and components."""
    parts = blocks.select("dim", "block", "label", "v").mapInArrow(_zones, ZONE)
    over = lambda c, f: F.reduce(F.collect_list(c), F.first(c), lambda a, b: F.zip_with(a, b, f)).alias(c)  # noqa: E731 - a block has few batches
    return parts.groupBy("dim", "block").agg(F.min("label_lo").alias("label_lo"), F.max("label_hi").alias("label_hi"), over("lo", lambda a, b: F.least(a, b)), over("hi", lambda a, b: F.greatest(a, b)))


def _interval(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of each anchor with the vectors of each block, a little wide for rounding."""
    q, lo, hi = q.astype(float), lo.astype(float), hi.astype(float)
    pos, neg = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T + 1)
    return pos @ lo.T + neg @ hi.T - slack, pos @ hi.T + neg @ lo.T + slack


#: Anchors with their windows: hits of window w lie between lo and hi, and only those from ``least`` on matter;
#: those of block ``home`` have been found already.
ASK = ["dim", "team", "anchor_id", "anchor_key", "label", "v", "lo", "hi", "least", "home"]


def _reach(ask: pa.Table, low: np.ndarray, high: np.ndarray, zones: tuple[np.ndarray, np.ndarray], same: bool) -> np.ndarray:
    """Which blocks (columns) may have hits of which anchors (rows)."""
    label = ask["label"].to_numpy()[:, None]
    fits = (zones[0] <= label) & (label <= zones[1]) if same else (zones[0] != label) | (zones[1] != label)
    at_least = np.array([min(x, default=MOST) for x in ask["least"].to_pylist()], float)[:, None]
    at_most = np.array([max(x, default=LEAST) for x in ask["hi"].to_pylist()], float)[:, None]
    return fits & (high >= at_least) & (low <= at_most)


def _choose(same: bool, best: bool):
    def run(ask: pa.Table, zones: pa.Table) -> pa.Table:
        names = ["dim", "block", "team", "anchor_id", "anchor_key", "bound"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not ask.num_rows or not zones.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        low, high = _interval(_matrix(ask), _matrix(zones, "lo"), _matrix(zones, "hi"))
        wanted = _reach(ask, low, high, (zones["label_lo"].to_numpy(), zones["label_hi"].to_numpy()), same)
        block, dim, team = zones["block"].to_numpy(), ask["dim"][0].as_py(), ask["team"][0].as_py()
        if best:
            bound = np.where(wanted, high, -np.inf)
            row, col = np.flatnonzero(wanted.any(1)), bound.argmax(1)[wanted.any(1)]
            cols = [block[col], ask["anchor_id"].to_numpy()[row], ask["anchor_key"].to_numpy()[row], bound[row, col]]
        else:
            col = np.flatnonzero(wanted.any(0))
            cols = [block[col], np.zeros(len(col), np.int64), np.zeros(len(col), np.int64), np.zeros(len(col))]
        full = [np.full(len(cols[0]), dim), cols[0], np.full(len(cols[0]), team), *cols[1:]]
        return pa.table([pa.array(c, k) for c, k in zip(full, kinds, strict=True)], names)

    return run


def choose(ask: DataFrame, zones: DataFrame, chunks: int, same: bool, best: bool = False) -> DataFrame:
    """(dim, block, team) that a team must read; ``best``: for each anchor its block of the largest bound."""
    dealt = zones.withColumn("chunk", F.col("block") % chunks).join(ask.select("dim", "team").distinct(), "dim")
    dealt = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])
    asked = ask.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    key = ["dim", "team", "chunk"]
    found = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_choose(same, best), "dim int, block int, team long, anchor_id long, anchor_key long, bound double")
    if best:
        return found.groupBy("dim", "team", "anchor_id", "anchor_key").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    return found.select("dim", "block", "team")


HITS = "anchor_id long, anchor_key long, w int, vec_id long, score long"


def _score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, exact; outside of 64 bits the nearest 64-bit number."""
    size = lambda m: math.sqrt((m.astype(float) ** 2).sum(1).max(initial=0))
    if size(x) * size(q) < EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return np.array([[max(LEAST, min(MOST, int((a * b).sum()))) for b in x.astype(object)] for a in q.astype(object)], np.int64).reshape(len(q), len(x))


def _read(same: bool, k: int):
    def run(block: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if block.num_rows and ask.num_rows:
            x, ids, labels = _matrix(block), block["vec_id"].to_numpy(), block["label"].to_numpy()
            ask = ask.filter(pa.compute.not_equal(ask["home"], block["block"][0]))
        if block.num_rows and ask.num_rows:
            low, high = _interval(_matrix(ask), x.min(0)[None], x.max(0)[None])
            ask = ask.filter(pa.array(_reach(ask, low, high, (labels.min(keepdims=True), labels.max(keepdims=True)), same)[:, 0]))
        if block.num_rows and ask.num_rows:
            scores = _score(x, _matrix(ask))
            for s, anchor, key, label, lo, hi, least in zip(scores, *(ask[c].to_pylist() for c in ("anchor_id", "anchor_key", "label", "lo", "hi", "least")), strict=True):
                own = np.flatnonzero(((labels == label) if same else (labels != label)) & (ids != anchor))
                s, who = s[own], ids[own]
                for w, (a, b, c) in enumerate(zip(lo, hi, least, strict=True)):
                    hit = np.flatnonzero((s >= max(a, c)) & (s <= b))
                    if len(hit) > k:
                        hit = hit[s[hit] >= np.partition(s[hit], -k)[-k]]
                    out += [(anchor, key, w, n, v) for v, n in sorted(zip(s[hit].tolist(), who[hit].tolist(), strict=True), key=lambda h: (-h[0], h[1]))[:k]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["anchor_id", "anchor_key", "w", "vec_id", "score"])

    return run


def _find(blocks: DataFrame, wanted: DataFrame, ask: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best hits of each window in each block. wanted: (dim, block, team), or also anchors that alone read the block."""
    pairs = wanted.select("dim", "block", "team").distinct()
    rows = blocks.select("dim", "block", "vec_id", "label", "v").join(pairs, ["dim", "block"])
    asked = ask.join(wanted, [c for c in wanted.columns if c != "block"])
    asked = asked.select(*[F.col(c).alias(c) for c in (*ASK, "block")])  # other attributes than those of the blocks' side
    key = ["dim", "block", "team"]
    return rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_read(same, k), HITS)


def _first(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "w").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(blocks: DataFrame, zones: DataFrame, chunks: int, ask: DataFrame, start: DataFrame, same: bool, k: int) -> DataFrame:
    """The first k hits of each window: in one block of each anchor first (start: dim, team, anchor_id, anchor_key, block), then in all that still matter."""
    key = ["anchor_id", "anchor_key"]
    first = stored(_find(blocks, start, ask.withColumn("home", F.lit(-1)), same, k), "first-hits")
    kth = first.groupBy(*key, "w").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).where("kth is not null")
    kth = kth.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))  # an entry for each window
    raised = F.transform("least", lambda x, w: F.greatest(x, F.try_element_at("kth", w)))
    home = start.select(*key, F.col("block").alias("home"))
    rest = ask.join(home, key, "left").join(kth, key, "left").withColumns({"least": F.when(F.col("kth").isNull(), F.col("least")).otherwise(raised), "home": F.coalesce("home", F.lit(-1))})
    rest = stored(rest.select(*ASK), "anchors")
    return _first(first.union(_find(blocks, choose(rest, zones, chunks, same), rest, same, k)), k)


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: int = 80, block_rows: int = BLOCK_ROWS, team_rows: int = TEAM_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (vec_id, embedding, label).

    An anchor's positives are its first rows of the same label by inner product
    of components floor(256 * x), ties by smaller vec_id; a positive's negatives
    the first rows of other labels whose score is at most the positive's and
    at least ``share`` percent of it, so a negative positive score has none.
    Rows with a null id, label, vector or component, or one that isn't finite,
    take no part. Rows with an anchor's id are no partners of it; anchor rows
    that repeat id, label and vector are one anchor, other repeated rows count
    each. Vectors of another dimension are no partners. An empty table gives an
    empty one; other columns aren't read.
    """
    rows = vectors(embeddings.select("vec_id", "embedding", F.col("label").cast("long").alias("label")), "label").where("label is not null")
    blocks = write_blocks(rows.withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), block_rows)
    zones = stored(zone_maps(blocks), "zone-maps")
    last, asked = blocks.agg(F.max("block"), F.count_if("anchor")).first()
    chunks, step = max(1, math.ceil(((last or 0) + 1) / ZONES)), max(1, team_rows * ((last or 0) + 1) // max(1, asked))
    one = blocks.where("anchor").groupBy("dim", F.col("vec_id").alias("anchor_id"), "label", "v").agg(F.min("block").alias("block"))
    one = one.withColumns({"anchor_key": F.xxhash64("label", "v"), "team": F.floor(F.col("block") / step)})
    longs = lambda *c: F.array(*c).cast("array<long>")
    bounds = {"lo": longs(F.lit(LEAST)), "hi": longs(F.lit(MOST)), "least": longs(F.lit(LEAST))}
    anchors = stored(one.withColumns(bounds), "anchors")
    place = ["dim", "team", "anchor_id", "anchor_key"]
    found = _search(blocks, zones, chunks, anchors.drop("block"), anchors.select(*place, "block"), True, positives)
    liked = stored(found.where("score >= 0").select("anchor_id", "anchor_key", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    less = F.expr(f"(positive_score div 100) * {100 - share} + ((positive_score % 100) * {100 - share}) div 100")
    windows = F.array_sort(F.collect_list(F.struct("place", (score - less).alias("lo"), score.alias("hi"))))  # one for each positive
    windows = liked.groupBy("anchor_id", "anchor_key").agg(windows.alias("windows"))
    sides = {"lo": F.col("windows.lo"), "hi": F.col("windows.hi"), "least": F.col("windows.lo")}
    ask = stored(anchors.drop("block", "lo", "hi", "least").join(windows, ["anchor_id", "anchor_key"]).withColumns(sides).withColumn("home", F.lit(-1)).select(*ASK), "anchors")
    start = stored(choose(ask, zones, chunks, False, best=True), "best-blocks").select(*place, "block")
    hits = _search(blocks, zones, chunks, ask.drop("home"), start, False, negatives)
    hits = hits.withColumn("place", F.col("w") + 1)  # windows stand in the order of their positives
    out = hits.join(liked, ["anchor_id", "anchor_key", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
