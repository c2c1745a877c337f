"""SentencePiece encoding and decoding: Viterbi over the sorted distinct words, forward values shared along common prefixes.

Pieces and scores come from a public model file, which is never trained here.
A text gets a leading space and is cut into words with the spaces before them,
which no piece goes past, and between letters and other characters, if no piece
has both side by side. Over a word's lattice of pieces:

* In a unigram model the path of the largest sum of scores is taken, a
  character without a piece costing the lowest score less 10.
* In a merge model (BPE) a step from one piece to the next is open only if
  merging the two pieces' characters, best score first, gives just these two.
  One open path reaches each prefix, and it is what merging the prefix gives,
  so the ids are those of the library.

Either way the value of a prefix doesn't depend on what follows, and words that
begin alike share it. Characters without a piece are spelt in bytes. No
normalisation takes place and a word mark in a text is spelt in bytes too, so
decoding gives back any text exactly.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters whose distinct words are sorted and encoded together.
BLOCK_CHARS = 4 << 20
#: Words that a task remembers from one block to the next, and their largest length.
CACHED_WORDS, CACHED_LENGTH = 120_000, 40
#: Pairs of pieces of which a task remembers whether they may stand together.
CACHED_PAIRS = 300_000
#: Texts that are encoded at a time where their ids are returned.
ROWS = 256

#: Spaces and what follows them up to the next space; no piece goes past its end.
_MARKED = re.compile(r" *[^ ]+| +$")


def cutter(pieces: Iterable[str]) -> re.Pattern:
    """What cuts a marked text into words: also between the pieces' letters and whatever else, if no piece has both side by side."""
    letters = sorted({c for p in pieces for c in p if c.isalpha()})
    spans: list[list[str]] = []
    for c in letters:
        if spans and ord(c) == ord(spans[-1][1]) + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    some = "".join(f"{a}-{b}" for a, b in spans)
    finer = re.compile(rf" *[{some}]+| *[^ {some}]+| +$") if some else _MARKED
    return finer if all(len(finer.findall(p)) == 1 for p in pieces) else _MARKED


@dataclass
class Vocabulary:
    """pieces: bytes by id, with spaces for marks; texts of the usable ones make the trie."""

    pieces: list[bytes]
    usable: list[tuple[str, int, float]]
    byte_ids: list[int]
    unknown: float
    merges: bool = True
    pairs: dict[int, bool] = field(default_factory=dict)
    child: list[dict[str, int]] = field(default_factory=list)
    piece: list[int] = field(default_factory=list)
    score: list[float] = field(default_factory=list)

    def grow(self) -> Vocabulary:
        """The trie over the pieces; made on the task's side."""
        self.child, self.piece, self.score = [{}], [-1], [0.0]
        for text, i, s in self.usable:
            at = 0
            for c in text:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.piece.append(-1)
                    self.score.append(0.0)
                at = nxt
            self.piece[at], self.score[at] = i, s
        self.cut = cutter([t for t, *_ in self.usable])
        self.text = {i: t for t, i, _ in self.usable}
        self.rank = {t: s for t, _, s in self.usable}
        return self

    def merged(self, text: str) -> list[str]:
        """What merging adjacent parts, the best-scored first and then the leftmost, makes of a text."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            found = [(-rank[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in rank]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def open(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        if (known := self.pairs.get(a << 32 | b)) is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self.pairs[a << 32 | b] = self.merged(x + y) == [x, y]
        return known


def load(path: str = MODEL, merges: bool = True) -> Vocabulary:
    """Reads a model file with byte pieces, on the driver: its size is that of the vocabulary. merges: the model is a merge model, not a unigram one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, usable, byte_ids = [], [], [-1] * 256
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            pieces.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            text = p.replace(MARK, " ")
            if re.search(r"[^ ] ", text):
                raise ValueError(f"a piece goes past a word's end: {p!r}")
            pieces.append(text.encode())
            usable.append((text, i, sp.get_score(i)))
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces")
    return Vocabulary(pieces, usable, byte_ids, min(s for *_, s in usable) - UNKNOWN_PENALTY, merges)


def encode_words(words: list[str], v: Vocabulary) -> dict[str, list[int]]:
    """The best segmentation of each distinct marked word.

    Words are taken in sorted order, which is a depth-first walk of their trie.
    For each depth of the current path there are that prefix's last piece and
    the pieces that are still open; the next word starts at the depth of the
    prefix that it shares with the last one.
    """
    step = (_merging if v.merges else _summing)(v)
    back = [(-1, 0)]  # by depth: the last piece (-1: spelt in bytes) and where it began
    opened: list[list[tuple[int, int]]] = [[(0, 0)]]  # by depth: (where it began, node) of pieces in progress
    out, last = {}, ""
    for word in sorted(words):
        depth, most = 0, min(len(word), len(last))
        while depth < most and word[depth] == last[depth]:
            depth += 1
        del back[depth + 1 :], opened[depth + 1 :]
        step(word, depth, back, opened)
        ids: list[int] = []
        at = len(word)
        while at:
            p, start = back[at]
            if p >= 0:
                ids.append(p)
            else:
                ids += [v.byte_ids[b] for b in reversed(word[start].encode())]
            at = start
        ids.reverse()
        out[word] = ids
        last = word
    return out


def _merging(v: Vocabulary):
    """Goes on from a depth to a word's end, in a merge model: of the paths that reach a prefix one is open, so nothing is weighed."""
    child, piece, pairs, may = v.child, v.piece, v.pairs, v.open

    def step(word: str, depth: int, back: list, opened: list) -> None:
        for j in range(depth, len(word)):
            c, now, how = word[j], [], None
            for start, node in opened[j]:
                if (nxt := child[node].get(c)) is not None:
                    if child[nxt]:
                        now.append((start, nxt))
                    if how is None and (p := piece[nxt]) >= 0:
                        if start == 0 or (q := back[start][0]) < 0 or (may(q, p) if (known := pairs.get(q << 32 | p)) is None else known):
                            how = (p, start)
            now.append((j + 1, 0))
            back.append(how or (-1, j))  # in bytes also what no open path reaches
            opened.append(now)

    return step


def _summing(v: Vocabulary):
    """The same in a unigram model, where the best sum of scores counts."""
    child, piece, score, unknown, best = v.child, v.piece, v.score, v.unknown, [0.0]

    def step(word: str, depth: int, back: list, opened: list) -> None:
        del best[depth + 1 :]
        for j in range(depth, len(word)):
            c, now, top, how, single = word[j], [], -1e300, (-1, j), False
            for start, node in opened[j]:
                if (nxt := child[node].get(c)) is not None:
                    now.append((start, nxt))
                    if (p := piece[nxt]) >= 0:
                        single |= start == j
                        if (s := best[start] + score[nxt]) > top:
                            top, how = s, (p, start)
            if not single and best[j] + unknown > top:
                top, how = best[j] + unknown, (-1, j)
            now.append((j + 1, 0))
            best.append(top)
            back.append(how)
            opened.append(now)

    return step


def decode(ids, pieces: list[bytes]) -> str:
    return b"".join([pieces[i] for i in ids])[1:].decode()


class Encoder:
    """Whole texts to ids, block by block, with a bounded memory of words."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v.grow(), {}

    def __call__(self, texts) -> list[list[int]]:
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.packed(texts)]

    def packed(self, texts) -> list[bytes]:
        """The ids of each text as 32-bit integers, end to end."""
        out, block, size = [], [], 0
        for t in texts:
            block.append(t or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, texts: list[str]) -> list[bytes]:
        find, known = self.v.cut.findall, self.known
        split = [find(f" {t}") if t else [] for t in texts]
        words = set().union(*split)
        new = encode_words(list(words - known.keys()), self.v)
        known.update((w, array("i", ids).tobytes()) for w, ids in new.items())
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for w in new:
            if len(w) > CACHED_LENGTH:
                del known[w]
        if len(known) > CACHED_WORDS:  # words of before that came again are kept first
            kept = (w for w in chain(words - new.keys(), new) if len(w) <= CACHED_LENGTH)
            self.known = {w: known[w] for w in islice(kept, CACHED_WORDS)}
        return out


def _listed(packed: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
    """How many ids each text has, and the ids as an array of arrays."""
    sizes = np.array([len(i) // 4 for i in packed], np.int32)
    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))
    return sizes, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _encoder(df: DataFrame, v: Vocabulary):
    """What gives a task its encoder, made once."""
    shared, held = Shared(df, v), []

    def get() -> Encoder:
        if not held:
            held.append(Encoder(shared()))
        return held[0]

    return get


def encode_udf(df: DataFrame, v: Vocabulary):
    """text -> array of ids; null and empty texts have none."""
    encoder = _encoder(df, v)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(text: pa.Array) -> pa.Array:
        return _listed(encoder().packed(text.to_pylist()))[1]

    return encode


def encode_documents(docs: DataFrame, v: Vocabulary, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each document, n_tokens and ids, of its column ``text``; null and empty texts have no ids.

    Some hundred texts at a time are ids in a task's memory.
    """
    encoder = _encoder(docs, v)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                sizes, ids = _listed(encoder().packed(part.column(len(keep)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(sizes), ids], [*keep, "n_tokens", "ids"])

    return docs.select(*[docs[c] for c in keep], docs["text"].alias("encoded text")).mapInArrow(run, schema)


def decode_udf(df: DataFrame, v: Vocabulary):
    """array of ids -> text; a null array is an empty text."""
    shared = Shared(df, v.pieces)

    @F.arrow_udf(T.StringType())
    def decoded(ids: pa.Array) -> pa.Array:
        return pa.array(["" if i is None else decode(i, shared()) for i in ids.to_pylist()], pa.string())

    return decoded


_DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_byte_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])


def digest_udf(df: DataFrame, v: Vocabulary):
    """text -> how many ids, how many of them spell bytes, SHA-256 of the ids as 32-bit little-endian, whether they decode to the text."""
    encoder = _encoder(df, v)

    @F.arrow_udf(_DIGEST)
    def digest(text: pa.Array) -> pa.Array:
        text = text.to_pylist()
        mine = encoder().v
        spelt = np.zeros(len(mine.pieces), bool)
        spelt[mine.byte_ids] = True
        rows = []
        for t, packed in zip(text, encoder().packed(text), strict=True):
            ids = np.frombuffer(packed, np.int32)
            rows.append((len(ids), int(np.count_nonzero(spelt[ids])), hashlib.sha256(ids.astype("<u4", copy=False)).hexdigest(), decode(ids.tolist(), mine.pieces) == (t or "")))
        types = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _DIGEST.names)

    return digest
