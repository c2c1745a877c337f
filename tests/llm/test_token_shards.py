import hashlib
import os

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from fairgrid.llm import token_shards as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    a, b = S.feistel(np.arange(n), n, 1), S.feistel(np.arange(n), n, 2)
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 1000 or (a != b).mean() > 0.9 and np.abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.1
    assert S.feistel(np.array([n - 1]), n, 1)[0] == a[n - 1]


def test_shards_round_trip(spark, tmp_path):
    rows = [(i, f"Document {i} says " + "ünï\n\n x\0y " * (i % 40), "x") for i in range(200)]
    rows += [(None, None, "x"), (5, "", "x"), (5, "", "x"), (900, "long words " * 30_000, None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    ranks, length = S.load_ranks(), 64
    coder = tiktoken.Encoding("own", pat_str=S.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # the plain version: partitions end to end, cut into sequences, numbered, sorted by their keys
    parts = {}
    for r in docs.withColumn("p", F.spark_partition_id()).collect():
        parts.setdefault(r.p, []).append((r.doc_id, r.text or ""))
    want, base = [], 0
    n = sum(-(-sum(len(t.encode()) + 1 for _, t in part) // length) for part in parts.values())
    for _, part in sorted(parts.items()):
        stream, of = [], []
        for i, t in part:
            ids = [*coder.encode_ordinary(t), len(ranks)]
            of += [(len(of), i)] if not ids else [(j, i) for j in [len({x for x, _ in of})] for _ in ids]
            stream += ids
        for k, at in enumerate(range(0, len(stream), length)):
            key = int(S.feistel(np.array([base + k]), n, S.KEY)[0])
            want.append((key, stream[at : at + length], of[at][1], len({x for x, _ in of[at : at + length]})))
        base += -(-sum(len(t.encode()) + 1 for _, t in part) // length)
    want.sort()
    out = str(tmp_path / "shards")
    S.write_shards(docs, ranks, out, length, shard_bytes=20_000)
    stored = sorted(S.read_shards(spark, out, length).collect())
    assert [r.slot for r in stored] == list(range(len(want)))
    for r, (_, ids, doc, n_docs) in zip(stored, want, strict=True):
        assert np.frombuffer(r.tokens, "<u2").tolist() == ids + [0] * (length - len(ids))
        assert (r.n_tokens, r.first_doc_id, r.n_docs) == (len(ids), doc, n_docs)
    assert len({r.shard for r in stored}) > 3 and sum(r.n_tokens < length for r in stored) <= 3
    # a reader resumes at a slot
    for s in (0, 7, len(want) - 3, len(want)):
        assert sorted(S.read_shards(spark, out, length, s).collect()) == stored[s:]
    # and finds a record by its shard and offset alone
    r = stored[-3]
    (name,) = [x for x in os.listdir(f"{out}/shard={r.shard}") if x.startswith("part-")]
    with open(f"{out}/shard={r.shard}/{name}", "rb") as f:
        f.seek(r.offset)
        record = f.read(S.stride(length))
    assert record[-2 - 2 * length : -2] == bytes(r.tokens) and record[-2:] == S.CLOSE
    digest = S.read_shards(spark, out, length).where(F.col("slot") == r.slot).select(S.used(F.col("tokens"))).first()[0]
    assert digest == hashlib.sha256(bytes(r.tokens)).hexdigest()
    S.write_shards(docs, ranks, out + "2", length, shard_bytes=20_000)
    assert sorted(S.read_shards(spark, out + "2", length).collect()) == stored


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    S.write_shards(docs, S.load_ranks(), str(tmp_path / "none"), 64)
    assert S.read_shards(spark, str(tmp_path / "none"), 64).count() == 0
