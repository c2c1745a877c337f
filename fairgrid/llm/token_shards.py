"""Token ids in training order: a keyed permutation gives every sequence its slot in fixed-stride binary shards.

Sequences are numbered within bounds that the texts' bytes set, so that texts
are tokenized once and ids are moved once. A Feistel permutation of the range
of these numbers, walked on while outside, gives each its key; shards are equal
ranges of keys, in the order of the keys, and a sequence's slot is its place in
all shards: the shards before count by their file lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, cut, small

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of the tokenizer's public definition (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEQUENCE, KEY, ROUNDS = 512, 20240601, 6
#: Bytes of text whose ids make one shard, on average; so many shards in a row are shuffled as one.
SHARD_BYTES, RANGE_SHARDS = 4 << 20, 4
#: Bytes of records that a task collects before it packs them by range.
COLLECTED = 64 << 20
#: A record's last two bytes; the text writer's line separator, so that its files are fixed-stride binaries.
CLOSE = b"\0\0"


def feistel(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walked on while outside.

    Each place of x moves by itself, so tasks need nothing of each other.
    """
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for r in range(rounds):
            z = right + np.uint64((key + r * 0x9E3779B97F4A7C15) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def record_type(length: int) -> np.dtype:
    """A record: the first document's id (known: it isn't null), how many documents and ids are in it, the ids, zeros to fill."""
    return np.dtype([("doc_id", "<i8"), ("n_docs", "<u2"), ("n_tokens", "<u2"), ("known", "<u4"), ("ids", "<u2", (length,))])


def stride(length: int) -> int:
    return record_type(length).itemsize + len(CLOSE)


def _placed(length: int, key: int, first: dict[int, int], n: int, shards: int, shared: Shared):
    """(doc_id, text) of one partition, end to end, to packed records by range of shards; first: where each partition's numbers begin."""
    kind = record_type(length)
    per = -(-n // shards)

    def packed(keys: list[np.ndarray], records: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, r = np.concatenate(keys), np.concatenate(records)
        order = np.argsort(k)
        k, r = k[order], r[order]
        of = k // (per * RANGE_SHARDS)
        codec = pa.Codec("zstd", compression_level=3)
        for lo, hi in zip(at := np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), [*at[1:], len(of)], strict=True):
            data = codec.compress(k[lo:hi].tobytes() + r[lo:hi].tobytes(), asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([of[lo]], pa.int64()), pa.array([hi - lo], pa.int32()), pa.array([data], pa.binary())], ["range", "n", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        ranks, pattern = shared()
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        end = [len(ranks)]
        number, last = first.get(p := TaskContext.get().partitionId(), 0), first.get(p, 0) + first.get(~p, 0)
        rest, docs, starts = np.zeros(0, "<u2"), [], np.zeros(0, np.int64)  # what no sequence has yet, and the documents it is of
        keys, records, size = [], [], 0

        def made(data: np.ndarray, k: int) -> None:
            nonlocal number, size
            edges = np.arange(k) * length
            lo, hi = np.searchsorted(starts, edges, "right") - 1, np.searchsorted(starts, np.minimum(edges + length, len(data)), "left")
            out = np.zeros(k, kind)
            whole = data[: k * length]
            out["ids"] = np.concatenate((whole, np.zeros(k * length - len(whole), "<u2"))).reshape(k, length)
            out["n_tokens"] = np.minimum(length, len(data) - edges)
            out["n_docs"] = hi - lo
            out["known"] = [docs[i] is not None for i in lo]
            out["doc_id"] = [docs[i] or 0 for i in lo]
            if number + k > last:
                raise RuntimeError("the texts changed between two passes; cut() the input")
            keys.append(feistel(np.arange(number, number + k), n, key))
            records.append(out)
            number += k
            size += out.nbytes

        for b in batches:
            ids = [np.array(coder.encode_ordinary(t) + end, "<u2") for t in b.column(1).to_pylist()]
            sizes = np.array([len(i) for i in ids], np.int64)
            docs = docs + b.column(0).to_pylist()
            starts = np.concatenate((starts, len(rest) + np.cumsum(sizes) - sizes))
            data = np.concatenate([rest, *ids])
            if k := len(data) // length:
                made(data, k)
            rest = data[k * length :].copy()
            open_ = max(0, np.searchsorted(starts, k * length, "right") - 1) if len(rest) else len(docs)
            docs, starts = docs[open_:], np.maximum(0, starts[open_:] - k * length)
            if size >= COLLECTED:
                yield from packed(keys, records)
                keys, records, size = [], [], 0
        if len(rest):
            made(rest, 1)
        if keys:
            yield from packed(keys, records)

    return run


def write_shards(docs: DataFrame, ranks: dict[bytes, int], path: str, length: int = SEQUENCE, key: int = KEY, shard_bytes: int = SHARD_BYTES, pattern: str = PATTERN) -> None:
    """Files path/shard=<k>/part-*: the documents' ids in sequences of ``length``, in the order of their slots, stride(length) bytes each.

    Documents follow one another in the order of the table's partitions, each
    with an end id (the next free one) after its last; only a partition's last
    sequence may be short, and is filled with zeros. Ids have 16 bits. The same
    files, settings and key give the same shards. A null text counts as empty:
    a single end id. Repeated rows each have their ids. An empty table gives no
    shard. Two numbers a partition come to the driver. Spark's committer puts a
    finished task's files in place, so a lost one leaves nothing half-written,
    on any file system that Spark can write to.
    """
    if len(ranks) + 1 > 1 << 16 or length >= 1 << 16:
        raise ValueError("ids and the length of a sequence must fit in 16 bits")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # an id is of one byte or more, so a partition has no more ids than bytes and ends
    bytes_ = sorted(rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).collect())
    first, n = {}, 0
    for p, size in bytes_:
        first[p], first[~p] = n, -(-size // length)
        n += first[~p]
    shards = max(1, round(sum(size for _, size in bytes_) / shard_bytes))
    shared = Shared(docs, (ranks, pattern))
    kind, per = record_type(length), -(-max(1, n) // shards)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = pa.decompress(data.as_buffer(), m * (8 + kind.itemsize), "zstd", asbytes=True)
                for at in range(0, m, 4096):
                    k = np.frombuffer(data, np.int64, min(4096, m - at), 8 * at)
                    r = np.frombuffer(data, kind, len(k), 8 * m + kind.itemsize * at)
                    yield pa.RecordBatch.from_arrays([pa.array((k // per).astype(np.int32)), pa.array(k), pa.array([x.tobytes() for x in r], pa.binary())], ["shard", "key", "record"])

    out = rows.mapInArrow(_placed(length, key, first, n, shards, shared), "range long, n int, packed binary").repartition("range")
    out = out.select("n", "packed").mapInArrow(unpacked, "shard int, key long, record binary").sortWithinPartitions("shard", "key")
    # records are bytes in a string column: the text writer puts them out as they are
    out = out.select("shard", F.col("record").cast("string").alias("value"))
    out.write.partitionBy("shard").option("lineSep", CLOSE.decode()).text(path)
    shared.destroy()


def shard_table(spark: SparkSession, path: str, length: int = SEQUENCE) -> DataFrame | None:
    """(shard, base, n): the first slot of each shard and how many it has, by file lengths; None without shards."""
    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:
        return None
    n = files.select("shard", (F.col("length") / stride(length)).cast("long").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return cut(n.select("shard", F.coalesce(before, F.lit(0)).alias("base"), "n"))


_STORED = "slot long, shard int, offset long, first_doc_id long, n_docs int, n_tokens int, tokens binary"


def read_shards(spark: SparkSession, path: str, length: int = SEQUENCE, from_slot: int = 0) -> DataFrame:
    """(slot, shard, offset, first_doc_id, n_docs, n_tokens, tokens) of written shards from a slot on; shards before it aren't read.

    tokens has the zero bytes that fill a record; offset is the record's place in its file.
    """
    table, kind, step = shard_table(spark, path, length), record_type(length), stride(length)
    if table is None:
        return spark.createDataFrame([], _STORED)
    since = table.where(F.col("base") + F.col("n") > from_slot).agg(F.min("shard")).first()[0]
    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= (since if since is not None else 2**31 - 1)).select("shard", "content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(data) % step:
                    raise ValueError(f"shard {k} isn't a whole number of records")
                n = len(data) // step
                for i in range(max(0, from_slot - base), n, 4096):
                    at = np.arange(i, min(n, i + 4096))
                    r = np.concatenate([np.frombuffer(data, kind, 1, step * j) for j in at])
                    ids = pa.array(np.where(r["known"] == 1, r["doc_id"], 0), mask=r["known"] != 1)
                    columns = [pa.array(base + at), pa.array(np.full(len(at), k, np.int32)), pa.array(at * step), ids, pa.array(r["n_docs"].astype(np.int32)), pa.array(r["n_tokens"].astype(np.int32)), pa.array([x.tobytes() for x in r["ids"]], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "offset", "first_doc_id", "n_docs", "n_tokens", "tokens"])

    return files.join(small(table.select("shard", "base")), "shard").select("shard", "content", "base").mapInArrow(split, _STORED)


def used(tokens: Column) -> Column:
    """A stored record's SHA-256, as lowercase hex."""
    return F.sha2(tokens, 256)
