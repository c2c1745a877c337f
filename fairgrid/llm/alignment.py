"""Alignment of two tokenizers' tokens over the same bytes, and how well each link of a text agrees with the corpus.

Both tokenizers' tokens tile the bytes of space + text. Their end offsets are
two rising arrays, and a byte where both have an end closes a group. The walk
keeps the shift between the arrays' indexes: while ends are equal at that shift
it probes ahead 16, 32, 64, ... entries at once and jumps the whole stretch of
one-to-one groups; where they differ, the array that is behind catches up until
both end, which closes an irregular group and gives the new shift.

Corpus counts of id pairs are sums over blocks of documents. Each block then
gets the counts of the pairs that occur in it by a join, so nothing is
broadcast and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, stored

#: Rows, and bytes of text, of a block: what one task has of the corpus at a time.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: Bytes of text that are aligned at once; longer texts are taken apart where both tokenizers must end.
PIECE = 1 << 18
#: Spans of text whose ids a worker remembers (up to twice as many), and the longest one.
KNOWN_SPANS, KNOWN_LENGTH = 200_000, 64
#: Neither tokenizer has a token across such a place: the first has none with white space after other
#: characters, and this is checked of the second.
CUTS = re.compile(r"(?<=\S) ")
#: Where this isn't found, every space is such a place.
SPACED = re.compile(r"\s ")
#: Pair code: first id * ID_SPACE + second id.
ID_SPACE = 1 << 16


@dataclass
class Tokenizers:
    """The vocabularies of both; a task builds its encoders from them once."""

    ranks: dict[bytes, int]
    pattern: str
    model: bytes
    made: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "model": self.model, "made": None}

    def build(self) -> tuple:
        if self.made is None:
            import sentencepiece
            import tiktoken

            first = tiktoken.Encoding("first", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
            second = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            size = max(self.ranks.values()) + 1
            lengths = np.zeros(size, np.int64)
            for token, i in self.ranks.items():
                lengths[i] = len(token)
            pieces = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(second.id_to_piece, range(second.get_piece_size())))]
            if any(" " in p.decode(errors="replace").lstrip(" ") for p in pieces):
                raise ValueError("the second tokenizer has pieces that go across words")
            if max(size, len(pieces)) > ID_SPACE:
                raise ValueError(f"ids must be below {ID_SPACE}")
            names = np.array([f"{i}{mark}" for last in ((",", "|"), (",", ";")) for mark in last for i in range(ID_SPACE)], "S6")  # padded with zero bytes
            self.made = first, second, lengths, pieces, np.array([len(p) for p in pieces]), names
        return self.made


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 32]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def load(folder: str | None = None, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model") -> Tokenizers:
    """Reads both vocabularies from ``folder`` (None: that of the installed public tokenizers).

    The first must be byte-level BPE with the usual pattern and ids in the order of its merges.
    """
    at = Path(folder) if folder else Path(importlib.util.find_spec("public_tokenizers").origin).parent
    said = json.loads((at / first).read_text())
    alphabet, special = _byte_of(), {t["content"] for t in said["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
    return Tokenizers(ranks, importlib.import_module("public_tokenizers").PATTERN, (at / second).read_bytes())


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Stretches (i, j, p, q) of two rising int64 arrays with the same last entry, in order, one row each.

    p = q > 0: that many groups of one token each; p = q < 0: one irregular
    group of -p tokens each; else one group of p and q tokens.
    """
    a, b = ends_a.tolist(), ends_b.tolist()
    x, y = ends_a.tobytes(), ends_b.tobytes()  # eight bytes an entry: stretches are compared as memory
    out, i, j, n = array("q"), 0, 0, len(a)
    while i < n:
        if a[i] == b[j]:
            at, other, step = 8 * i + 8, 8 * j + 8, 128
            while (ahead := x[at : at + step]) and ahead == (beside := y[other : other + step]):
                at += len(ahead)
                other += len(ahead)
                step *= 2
            run = at // 8 - i
            if ahead:  # the first entry that differs holds the lowest bit that differs
                differ = int.from_bytes(ahead, "little") ^ int.from_bytes(beside, "little")
                run += ((differ & -differ).bit_length() - 1) // 64
            out.extend((i, j, run, run))
            i += run
            j += run
        else:
            i0, j0 = i, j
            u, v = a[i], b[j]
            while u != v:
                if u < v:
                    i += 1
                    u = a[i]
                else:
                    j += 1
                    v = b[j]
            i += 1
            j += 1
            p, q = i - i0, j - j0
            out.extend((i0, j0, p, q) if p != q else (i0, j0, -p, -q))
    return np.frombuffer(out, np.int64).reshape(-1, 4)


def _starts(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of every group, in both."""
    i, j, p, q = found.T
    one = (p == q) & (p > 0)
    times = np.where(one, p, 1)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(i, times) + step, np.repeat(j, times) + step


def _sizes(first: np.ndarray, n: int) -> np.ndarray:
    """Sizes of groups that begin at ``first`` and fill ``n`` places."""
    size = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=size[:-1])
    size[-1:] = n - first[-1:]
    return size


def links(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of tokens that share a byte: of a one-to-one group its pair, of others each stretch between neighbouring ends."""
    p, q = _sizes(first_a, len(ends_a)), _sizes(first_b, len(ends_b))
    single = (p == 1) & (q == 1)
    more_a, more_b = np.flatnonzero(np.repeat(~single, p)), np.flatnonzero(np.repeat(~single, q))
    ends_a, ends_b = ends_a[more_a], ends_b[more_b]
    ends = np.union1d(ends_a, ends_b)
    i, j = more_a[np.searchsorted(ends_a, ends)], more_b[np.searchsorted(ends_b, ends)]
    return np.concatenate((first_a[single], i)), np.concatenate((first_b[single], j))


class Aligner:
    """Documents' alignments; remembers the ids of short spans of text, 16 bits each."""

    def __init__(self, t: Tokenizers):
        self.first, self.second, self.len_a, self.pieces, self.len_b, self.names = t.build()
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def _second(self, text: str) -> np.ndarray:
        """Ids of space + text, where the tokenizer adds the space itself (but not to an empty text); none where they don't give that back."""
        ids = self.second.encode(text) or [self.second.piece_to_id("▁")]
        whole = b"".join(map(self.pieces.__getitem__, ids)) == b" " + text.encode()
        return np.array(ids if whole else [], np.uint16)

    def _learn(self, spans: list[str]) -> None:
        """Ids of space + span for spans that aren't known, by one call for all of them together."""
        text = " ".join(spans)
        size = np.cumsum([len(s.encode()) + 1 for s in spans])
        for coded, lengths, known in ((np.array(self.first.encode_ordinary(f" {text}"), np.uint16), self.len_a, self.known_a), (self._second(text), self.len_b, self.known_b)):
            if len(spans) > 1 and not len(coded):  # spans that the second tokenizer changes
                known.update((s, self._second(s).tobytes()) for s in spans)
                continue
            ends, data = lengths[coded].cumsum(), coded.tobytes()
            at = np.searchsorted(ends, size, "right")
            if len(coded) and (ends[at - 1] != size).any():
                raise ValueError("a token goes across a place where texts are taken apart")
            last = 0
            for span, stop in zip(spans, (2 * at).tolist(), strict=True):
                known[span] = data[last:stop]
                last = stop

    def _pieces(self, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Bytes and ids of parts of space + text; none of the second where it doesn't give a part back."""
        spans, lo = CUTS.split(text) if SPACED.search(f" {text}") else text.split(" "), 0
        while lo < len(spans):
            hi, size = len(spans) if len(text) <= PIECE else lo, 0
            while hi < len(spans) and size < PIECE:
                size += len(spans[hi]) + 1
                hi += 1
            piece = spans[lo:hi]
            if len(self.known_a) > KNOWN_SPANS:
                self.older, self.known_a, self.known_b = (self.known_a, self.known_b), {}, {}
            new, older = [s for s in dict.fromkeys(piece) if s not in self.known_a], self.older
            for s in new:
                if s in older[0]:
                    self.known_a[s], self.known_b[s] = older[0].pop(s), older[1].pop(s)
            if new := [s for s in new if s not in self.known_a]:
                self._learn(new)
            a, b = (np.frombuffer(b"".join(map(known.__getitem__, piece)), np.uint16).astype(np.int64) for known in (self.known_a, self.known_b))
            for s in new:
                if len(s) > KNOWN_LENGTH:
                    del self.known_a[s], self.known_b[s]
            yield len(" ".join(piece).encode()) + 1, a, b
            lo = hi

    def document(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, the groups' hash, pair codes and how often each is linked."""
        nothing = (0, 0, 0, 0, "", np.array([], np.uint32), np.array([], np.int64))
        if not text:
            return nothing
        sums, said, codes = [0, 0, 0, 0], hashlib.sha256(), []
        for size, a, b in self._pieces(text):
            ends_a, ends_b = self.len_a[a].cumsum(), self.len_b[b].cumsum()
            if not len(b) or ends_a[-1] != size or ends_b[-1] != size:
                return nothing
            first_a, first_b = _starts(groups(ends_a, ends_b))
            p, q = _sizes(first_a, len(a)), _sizes(first_b, len(b))
            # the groups' text: each group's first ids, then its second ones, each with the mark that follows it
            order, marked_a, marked_b = np.empty(len(a) + len(b), np.int64), a.copy(), b + 2 * ID_SPACE
            marked_a[first_a + p - 1] += ID_SPACE
            marked_b[first_b + q - 1] += ID_SPACE
            order[np.arange(len(a)) + np.repeat(first_b, p)] = marked_a
            order[np.arange(len(b)) + np.repeat(first_a + p, q)] = marked_b
            written = self.names[order].tobytes().translate(None, b"\0")[:-1]
            said.update(b";" + written if codes else written)
            i, j = links(ends_a, ends_b, first_a, first_b)
            codes.append(a[i] * ID_SPACE + b[j])
            sums = [x + y for x, y in zip(sums, (len(a), len(b), len(first_a), len(i)), strict=True)]
        pairs, n = np.unique(np.concatenate(codes), return_counts=True)
        return (*sums, said.hexdigest(), pairs.astype(np.uint32), n)


def _pack(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Rising codes as steps and their counts, compressed."""
    return zlib.compress(np.diff(codes, prepend=np.uint32(0)).astype("<u4").tobytes() + n.astype("<u4").tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.frombuffer(zlib.decompress(blob), "<u4").reshape(2, -1)
    return steps.cumsum(dtype=np.uint32), n.astype(np.int64)


ALIGNED = "block long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


#: A worker's aligner, by the broadcast that it was made from; tasks after the first find it there.
_made: dict[int, Aligner] = {}


def _align(tokenizers: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizers.name not in _made:
            _made.clear()
            _made[tokenizers.name] = Aligner(tokenizers())
        aligner, block, rows, size = _made[tokenizers.name], TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    block, rows, size = block + 1, 0, 0
                *sums, said, codes, n = aligner.document(text)
                for c, v in zip(cols, (block, None, *sums, said, _pack(codes, n)), strict=True):
                    c.append(v)
                rows, size = rows + 1, size + len(text or "")
            kinds = [pa.int64(), None, *[pa.int64()] * 4, pa.string(), pa.binary()]
            arrays = [batch.column(0) if k is None else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return run


def _per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, code, n): what each block links, each pair of ids once per batch."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for block in np.unique(blocks):
            found = [_unpack(batch.column("pairs")[int(k)].as_py()) for k in np.flatnonzero(blocks == block)]
            codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block)), pa.array(codes.astype(np.int64)), pa.array(n)], ["block", "code", "n"])


def _agreement(docs: pa.Table, known: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links."""
    order = np.argsort(codes := known["code"].to_numpy())
    codes, total, best = codes[order], known["total"].to_numpy()[order], known["best"].to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    for blob in docs["pairs"]:
        own, n = _unpack(blob.as_py())
        at = np.searchsorted(codes, own)
        n_best.append(int(n[best[at]].sum()) if len(own) else 0)
        count_sum.append(int((n * total[at]).sum()) if len(own) else 0)
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, code) of what blocks link, and (code, total, best) over the corpus; best: no other first id has more links with the second one."""
    per_block = aligned.where("n_links > 0").select("block", "pairs").mapInArrow(_per_block, "block long, code long, n long")
    totals = stored(per_block.groupBy("code").agg(F.sum("n").alias("total")), "pair-totals")
    second = (F.col("code") % ID_SPACE).alias("second")
    most = totals.groupBy(second).agg(F.max("total").alias("most"))
    counts = totals.join(most, totals["code"] % ID_SPACE == most["second"]).select("code", "total", (F.col("total") == F.col("most")).alias("best"))
    return per_block.select("block", "code").distinct(), counts


def align_documents(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs``.

    Texts are tokenized once; what later steps need of them is written to the
    shared folder as each document's distinct pairs. Null and empty texts, and
    those that either tokenizer doesn't give back byte for byte, have zeros and
    an empty hash. Repeated rows count each; null ids stay null; an empty table
    gives an empty one. Other columns of ``docs`` aren't read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    sent = Shared(docs, tokenizers)
    aligned = stored(docs.select("doc_id", "text").mapInArrow(_align(sent), ALIGNED.format(id=kind)), "aligned")
    sent.destroy()
    blocks, counts = pair_counts(aligned)
    known = blocks.join(counts, "code")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = aligned.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_agreement, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
