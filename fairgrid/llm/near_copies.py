"""Near-duplicate documents by content: SimHash trie joins find families, exact similarity settles them.

Two documents are linked if the Jaccard similarity of their sets of five-word
shingles is ``threshold`` or more.

1. Dealing. Of two sets that similar, the first (1 - threshold) of each set's
   shingles, in any order that is the same for all, have one in common.
   Frequent shingles of a sample come last in that order; this saves work and
   changes no result. Documents meet in the groups of these shingles.
2. Families. In a group, the trie over the documents' SimHash fingerprints is
   joined with itself within an error budget; what is linked, in whatever
   group, is a family. The fingerprint has 256 bits: at similarity 0.8 some 39
   differ, with a deviation of 6, and between texts that have little in common
   128, so that a budget of BITS of them parts the two.
3. Verification. Within a family sets are compared exactly, cell by cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Shared, cut, fresh, small
from .graph import connected_components
from .simhash_dedup import _Forest, trie_links

SHINGLE, THRESHOLD = 5, 0.8
#: Error budgets of the whole fingerprint, and of its first 64 bits, which the trie is made of. Of pairs at the
#: threshold fewer than one of a million go beyond (bits differ with probability 0.152, 0.19 for sets of five).
BITS, FIRST_BITS = 80, 28
WORDS = ["f0", "f1", "f2", "f3"]
#: One document of so many is looked at for frequent shingles; so many of these are told apart.
SAMPLE, FREQUENT = 16, 100_000
#: Documents of a group that meet in one task; a larger group meets its first document, then the rest in blocks.
GROUP = 4096
#: Sets of a cell; cells of a family also have PIVOTS of its sets in common.
CELL, PIVOTS = 256, 4
#: Shingles of a cell whose counts are in memory at a time.
COLUMNS = 4096


def shingle_set(data: bytes, n: int = SHINGLE) -> np.ndarray:
    """Ascending distinct XXH64 of the shingles of UTF-8 text, as signed longs; fewer words than ``n`` are one shingle."""
    import xxhash

    words = data.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    lists = [words[i:] for i in range(n)] if len(words) > n else [[b" ".join(words)]]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*lists, strict=False)], np.uint64).view(np.int64))


def fingerprint(s: np.ndarray) -> np.ndarray:
    """SimHash of a set in four 64-bit words, each from hashes mixed anew: a bit is set if over half of them have it."""
    bits = np.zeros(256, np.int64)
    for at in range(0, len(s), 1 << 14):
        x = s[at : at + (1 << 14)].view(np.uint64)
        mixed = np.empty((len(x), 4), ">u8")
        for k in range(4):
            mixed[:, k] = x
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        bits += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * bits > len(s)).view(">u8").astype(np.uint64).view(np.int64)


def prefix_size(n: int, threshold: float) -> int:
    """So many first shingles of a set of n; sets of similarity ``threshold`` have threshold * n or more in common."""
    return n - int(np.ceil(n * threshold - 1e-9)) + 1 if n else 0


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sets(text: pa.Array) -> pa.Array:
    return _lists([shingle_set(t or b"") for t in text.to_pylist()])


_MADE = "sig long, size int, prefix array<long>, " + ", ".join(f"{w} long" for w in WORDS)


def _marks(frequent, threshold: float):
    """Of a text: sig, the size of its set, the set's first shingles, of which similar sets share one, and its fingerprint."""

    @F.arrow_udf(_MADE)
    def of(text: pa.Array) -> pa.Array:
        import xxhash

        hot, rank = frequent()
        sig, size, prefix, fp = [], [], [], []
        for t in text.to_pylist():
            s = shingle_set(t or b"")
            at = np.minimum(np.searchsorted(hot, s), max(0, len(hot) - 1))
            last = np.where(hot[at] == s, rank[at], 0) if len(hot) else np.zeros(len(s), np.int64)
            sig.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
            size.append(len(s))
            prefix.append(s[np.lexsort((s, last))][: prefix_size(len(s), threshold)])
            fp.append(fingerprint(s))
        words = np.array(fp, np.int64).reshape(-1, 4).T
        columns = [pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array(size, pa.int32()), _lists(prefix), *map(pa.array, map(np.ascontiguousarray, words))]
        return pa.StructArray.from_arrays(columns, ["sig", "size", "prefix", *WORDS])

    return of


def _bytes(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit("")).cast("binary")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending frequent shingles of a sample and their ranks, the most frequent last."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    n = some.select(F.explode(_sets(_bytes(some))).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    h = n.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()["h"].to_numpy()
    order = np.argsort(h)
    return h[order], np.arange(len(h), 0, -1)[order]


class _Family(_Forest):
    """Links documents whose fingerprints and set sizes allow the threshold; places are rows, nodes are documents."""

    def __init__(self, node: np.ndarray, size: np.ndarray, words: list[np.ndarray], bits: int, threshold: float):
        super().__init__(int(node.max()) + 1 if len(node) else 0)
        self.node, self.size, self.words, self.bits, self.threshold = node, size, words, bits, threshold

    def meet(self, i: np.ndarray, j: np.ndarray) -> None:
        off = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in self.words)
        a, b = self.size[i], self.size[j]
        near = (off <= self.bits) & (np.minimum(a, b) >= self.threshold * np.maximum(a, b) - 1e-9)
        self.link(self.node[i[near]], self.node[j[near]])


def _family_task(bits: int, first_bits: int, threshold: float):
    """For one Spark partition: whole groups of (h, part, sig, size, fingerprint); gives edges of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        h, part, sig, size, *words = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        words = [w.view(np.uint64) for w in words]
        order = np.lexsort((words[0], part, h))
        h, part, sig, size = (x[order] for x in (h, part, sig, size))
        words = [w[order] for w in words]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
        lo = np.flatnonzero(new)
        hi = np.concatenate((lo[1:], [len(h)]))
        sigs, node = np.unique(sig, return_inverse=True)
        forest = _Family(node, size, words, bits, threshold)
        forest.meet(np.arange(len(h)), np.repeat(lo, hi - lo))  # each with its group's first
        root = forest.roots()[node]
        apart = np.minimum.reduceat(root, lo) != np.maximum.reduceat(root, lo)
        lo, hi = lo[apart], hi[apart]
        zero = np.zeros(len(lo), np.int64)
        trie_links(words[0], lo, hi, lo, hi, zero, 0, first_bits, forest)
        root = forest.roots()
        linked = np.flatnonzero(root != np.arange(len(root)))
        for at in range(0, len(linked), 1 << 16):
            some = linked[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(sigs[some]), pa.array(sigs[root[some]])], ["u", "v"])

    return run


def families(posts: DataFrame, marks: DataFrame, threshold: float, group: int, bits: int = BITS, first_bits: int = FIRST_BITS) -> DataFrame:
    """(node, root) of the signatures that have a possible partner; root names the family.

    posts: (sig, size, h); marks: (sig, WORDS). A group of over ``group``
    documents first meets its first document, in a join that can be split; only
    what that leaves apart meets the whole group, block by block.
    """
    shared = cut(posts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    live = posts.join(shared, "h").join(marks, "sig").select("h", "n", "sig", "size", *WORDS)
    keep = ["h", "part", "sig", "size", *WORDS]
    stars = None
    if shared.where(F.col("n") > group).take(1):
        live = cut(live)
        large = live.where(F.col("n") > group)
        first = large.groupBy("h").agg(F.min(F.struct("sig", "size", *WORDS)).alias("l"))
        off = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"l.{w}"))) for w in WORDS), F.lit(0))
        fits = F.least("size", "l.size") >= F.greatest("size", "l.size") * F.lit(threshold) - 1e-9
        large = cut(large.join(first, "h").withColumn("near", (off <= bits) & fits))
        stars = large.where("near and sig != l.sig").select(F.col("sig").alias("u"), F.col("l.sig").alias("v")).distinct()
        open_ = large.where("not near").select("h").distinct()
        blocks = F.ceil(F.col("n") / group).cast("int")
        all_ = F.sequence(F.lit(0), blocks - 1)
        dealt = large.join(open_, "h", "left_semi").withColumn("part", F.explode(F.when(F.col("near"), F.array(F.pmod(F.xxhash64("sig"), blocks).cast("int"))).otherwise(all_)))
        groups = live.where(F.col("n") <= group).withColumn("part", F.lit(0)).select(*keep).union(dealt.select(*keep))
    else:
        groups = live.withColumn("part", F.lit(0)).select(*keep)
    edges = groups.repartition("h", "part").mapInArrow(_family_task(bits, first_bits, threshold), "u long, v long")
    return cut(connected_components(edges if stars is None else edges.union(stars)))


def similar(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of sets that are similar, compared exactly."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    both = np.zeros((n, n), np.float32)
    if n <= 8:
        for i in range(n):
            for j in range(i):
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]) - 1e-9:
                    both[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        kinds, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), size)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for first in range(0, len(kinds), COLUMNS):
            lo, hi = np.searchsorted(at, (first, first + COLUMNS))
            m = np.zeros((n, COLUMNS), np.float32)
            m[row[lo:hi], at[lo:hi] - first] = 1
            both += m @ m.T
    i, j = np.nonzero(np.tri(n, k=-1, dtype=bool) & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6) & (both > 0))
    return i, j


def _cell_task(threshold: float):
    """Sets of one cell to edges that connect the similar ones."""

    def run(cell: pa.Table) -> pa.Table:
        sigs, at = np.unique(cell["sig"].to_numpy(), return_index=True)
        column = cell["s"].combine_chunks()
        forest = _Forest(len(sigs))
        forest.link(*similar([column[i].values.to_numpy() for i in at.tolist()], threshold))
        root = forest.roots()
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(sigs[linked]), pa.array(sigs[root[linked]])], ["u", "v"])

    return run


def _compared(docs: DataFrame, cells: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """Edges of the cells: rows (at_id, at_tie, sig, key...) name the document whose text stands for a signature."""
    named = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    texts = named.join(small(cells), named["doc_id"].eqNullSafe(cells["at_id"]) & (named["tie"] == cells["at_tie"]))
    sets = texts.select("sig", _sets(_bytes(texts)).alias("s"), "places").select("sig", "s", F.explode("places").alias("at")).select("sig", "s", *[F.col(f"at.{k}").alias(k) for k in key])
    return cut(sets.groupBy(*key).applyInArrow(_cell_task(threshold), "u long, v long"))


def similar_links(docs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD, group: int = GROUP, cell: int = CELL) -> DataFrame:
    """(u, v) of signatures: edges that connect whatever is similar.

    ``rows`` has doc_id, tie, sig, size, prefix and fingerprint of each document
    of ``docs``. A family of over ``cell`` sets is dealt to cells, each with the
    same few pivots; sets that this leaves apart then meet cell by cell, those
    of one class never again.
    """
    classes = rows.groupBy("sig").agg(F.min(F.struct("doc_id", "tie")).alias("at"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), *[F.first(w).alias(w) for w in WORDS])
    posts = classes.select("sig", "size", F.explode("prefix").alias("h"))
    roots = families(posts, classes.select("sig", *WORDS), threshold, group)
    hashed = lambda k: F.xxhash64("sig", F.lit(k))
    kin = roots.groupBy("root").agg(F.ceil(F.count("*") / cell).cast("int").alias("k"), F.array(*[F.min_by("node", F.xxhash64("node", F.lit(p))) for p in range(PIVOTS)]).alias("pivots"))
    at = rows.groupBy("sig").agg(F.min(F.struct("doc_id", "tie")).alias("at"))
    nodes = cut(roots.withColumnRenamed("node", "sig").join(at, "sig").join(kin, "root").select("root", "sig", F.col("at.doc_id").alias("at_id"), F.col("at.tie").alias("at_tie"), "k", F.array_contains("pivots", F.col("sig")).alias("pivot")))
    whole = F.sequence(F.lit(0), F.col("k") - 1)
    parts = F.when(F.col("pivot"), whole).otherwise(F.array(F.pmod(hashed(0), F.col("k")).cast("int")))
    links = _compared(docs, nodes.withColumn("places", F.transform(parts, lambda p: F.struct(F.col("root"), p.alias("part")))), ["root", "part"], threshold)
    more = nodes.where("k > 1")
    if not more.take(1):
        return links
    # what is left of families of several cells: a class keeps to its own cells, small ones of a family share theirs
    found = connected_components(links)
    more = more.join(found.select(F.col("node").alias("sig"), F.col("root").alias("class")), "sig", "left").withColumn("class", F.coalesce("class", "sig"))
    size = more.groupBy("class").agg(F.count("*").alias("size"))
    more = more.join(size, "class").withColumn("owner", F.when(F.col("size") > cell // 2, F.col("class")))
    held = more.groupBy("root", "owner").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells")).withColumnsRenamed({"root": "root_", "owner": "owner_"})
    more = more.join(held, (F.col("root") == F.col("root_")) & F.col("owner").eqNullSafe(F.col("owner_")))
    more = cut(more.select("root", "owner", F.pmod(hashed(1), F.col("cells")).cast("int").alias("part"), "sig", "at_id", "at_tie"))
    cells = cut(more.select("root", "owner", "part").distinct().withColumn("cell", F.xxhash64("root", "owner", "part")))
    other = cells.select(F.col("root").alias("root_"), F.col("owner").alias("owner_"), F.col("cell").alias("cell_"))
    pairs = cells.join(other, (F.col("root") == F.col("root_")) & (F.col("cell") <= F.col("cell_"))).where("owner is null or owner_ is null or owner != owner_")
    pairs = cut(pairs.select("cell", "cell_"))
    ends = pairs.select("cell", F.struct(F.col("cell").alias("a"), F.col("cell_").alias("b")).alias("p")).union(pairs.where("cell != cell_").select("cell_", F.struct("cell", "cell_")))
    ends = ends.groupBy("cell").agg(F.collect_list("p").alias("places"))
    asked = cut(more.withColumn("cell", F.xxhash64("root", "owner", "part")).join(ends, "cell").select("sig", "at_id", "at_tie", "places"))
    return links.union(_compared(docs, asked, ["a", "b"], threshold))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one document of each group that is connected by similar pairs: the one of the smallest id, then the smallest text hash.

    Null, empty and wordless texts are equal. Rows equal in id and text count
    as one. All columns of ``docs`` stay as they are. Only ids of documents
    that go are sent to the texts.
    """
    frequent = Shared(docs, _frequent(docs))
    parts = docs.select("doc_id", F.xxhash64("text").alias("tie"), _marks(frequent, threshold)(_bytes(docs)).alias("p"))
    rows = cut(parts.select("doc_id", "tie", "p.*"))
    frequent.destroy()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("tie"))
    roots = cut(connected_components(similar_links(docs, rows, threshold)))
    classes = rows.groupBy("sig").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    classes = classes.join(small(roots).withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    classes = cut(classes)
    groups = classes.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("root", "first")
    several = cut(classes.select("sig", "root").join(groups, "root").select("sig", "first"))
    of = cut(rows.select("sig", order.alias("me")).join(small(several), "sig").groupBy("me", "first").agg(F.count("*").alias("n")))
    dropped = of.where("me != first").select(F.col("me.doc_id").alias("id_"), F.col("me.tie").alias("tie_"))
    again = cut(of.where("me = first and n > 1").select(F.col("me.doc_id").alias("id_"), F.col("me.tie").alias("tie_")))
    tie = fresh(docs, "tie")
    named = docs.withColumn(tie, F.xxhash64("text"))

    def meet(gone: DataFrame, how: str) -> DataFrame:
        return named.join(small(gone), named["doc_id"].eqNullSafe(gone["id_"]) & (named[tie] == gone["tie_"]), how)

    if not again.take(1):
        return meet(cut(dropped), "left_anti").drop(tie)
    # rows that repeat: only their texts are shuffled
    return meet(cut(dropped.union(again)), "left_anti").union(meet(again, "left_semi").dropDuplicates(["doc_id", tie])).drop(tie)
