import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fairgrid.llm import alignment as A

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain(texts, libraries):
    """Rows by whole texts, the libraries' own ids, and every pair of tokens compared."""
    first, second = libraries
    alphabet, out, total = A._byte_of(), [], Counter()
    for text in texts:
        a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            out.append(None)
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        said, lo = [], 0
        for e in ends:
            said.append("|".join(",".join(str(i) for i, (s, t) in zip(ids, own, strict=True) if lo <= s and t <= e) for ids, own in ((a, spans[0]), (b, spans[1]))))
            lo = e
        linked = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e]
        total.update(linked)
        out.append((len(a), len(b), len(ends), linked, hashlib.sha256(";".join(said).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(total[p] == most[p[1]] for p in r[3]), sum(total[p] for p in r[3]), r[4]) for r in out]


def test_against_every_pair_of_tokens(spark, libraries, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 40)
    rng = random.Random(1)
    words = ["the", "Straße", "unhappiness", "été", "don't", "日本語", "  ", "\n\n ", "\t", "x" * 90, "<|endoftext|>", "</s>", "<s>", "🙂", "á", "12345", "   deep", "\r\n", " ", "ﬁ", "\x1c y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    texts += ["", None, "▁ piece", "same text", "same text", " ", "\n", " lead", "trail ", "no\0byte"]
    docs = spark.createDataFrame([(None if i == 7 else i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, block string, n_a int").repartition(3)
    got = sorted((tuple(r) for r in A.align_documents(docs, A.load()).select(*COLUMNS).collect()), key=str)
    want = sorted(((None if i == 7 else i // 2, *r) for i, r in enumerate(plain(texts, libraries))), key=str)
    assert got == want
    assert sum(r[1] == 0 for r in got) >= 3


def test_a_long_text_and_small_blocks(spark, libraries, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 3)
    texts = ["word Wörter 123 " * 20_000, "a" * 3000, *["word Wörter"] * 20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in A.align_documents(docs, A.load()).collect()}
    first, second = libraries
    for i in (0, 1):
        assert got[i].n_a == len(first.encode(f" {texts[i]}", add_special_tokens=False).ids)
        assert got[i].n_b == len(second.encode(texts[i]))
        assert got[i].n_links == got[i].n_a + got[i].n_b - got[i].n_groups
    want = plain(texts[2:], libraries)[0]
    assert all(tuple(got[i])[1:5] == want[:4] and got[i].groups_sha256 == want[6] for i in range(2, 22))


def test_nothing_to_align(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert A.align_documents(empty, A.load()).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert [tuple(r) for r in A.align_documents(blank, A.load()).orderBy("doc_id").collect()] == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
@settings(max_examples=300, deadline=None)
def test_groups_close_where_both_end(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    i, j = A._starts(A.groups(np.array(a), np.array(b)))
    both = sorted(set(a) & set(b))
    assert [a[k - 1] for k in i[1:]] == both[:-1] == [b[k - 1] for k in j[1:]] and i[0] == j[0] == 0
