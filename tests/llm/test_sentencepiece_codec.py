import random

import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fairgrid.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def vocabulary():
    return S.load()


def texts():
    rng = random.Random(3)
    words = ["the", "thedoctor", "there", "Über", "naïve", "日本", "a", "b\nc", "x" * 70, "▁", "<s>", "<0x0A>", "🙂", "1,234.5", "foo_bar"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    return ["", " ", "  two  spaces ", "\n\n", "▁", "﻿x", "a" * 5000, *some]


def test_ids_are_the_librarys(vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist()
    plain = [t for t in texts() + docs if t and "▁" not in t]
    for t, ids in zip(plain, S.Encoder(vocabulary)(plain), strict=True):
        assert ids == sp.encode(t), t
        assert sp.decode(ids) == t


def test_unigram_takes_the_best_sum():
    usable = [(p, i + 256, s) for i, (p, s) in enumerate([(" ", -5.0), ("a", -3.0), ("b", -3.0), ("c", -4.0), (" a", -4.0), ("ab", -3.5), ("bc", -3.0), (" abc", -8.0), ("cab", -2.0)])]
    v = S.Vocabulary([bytes([i]) for i in range(256)] + [p.encode() for p, *_ in usable], usable, list(range(256)), -15.0, merges=False).grow()
    known = {p: (i, s) for p, i, s in usable}

    def best(word):
        top = [(0.0, [])]
        for j in range(1, len(word) + 1):
            found = [(top[i][0] + known[word[i:j]][1], [*top[i][1], known[word[i:j]][0]]) for i in range(j) if word[i:j] in known]
            if word[j - 1] not in known:
                found.append((top[j - 1][0] - 15.0, [*top[j - 1][1], *word[j - 1].encode()]))
            top.append(max(found, key=lambda x: x[0]))
        return top[-1]

    rng = random.Random(1)
    words = list({" " + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    score = lambda ids, w: sum(known[v.pieces[i].decode()][1] for i in ids if i > 255) - 15.0 * w.count("é")
    for w, ids in S.encode_words(words, v).items():
        assert score(ids, w) == best(w)[0] and b"".join(v.pieces[i] for i in ids).decode() == w


def test_round_trip_and_blocks(spark, vocabulary, monkeypatch):
    for t, ids in zip(texts(), S.Encoder(vocabulary)(texts()), strict=True):
        assert S.decode(ids, vocabulary.pieces) == t
    whole = S.Encoder(vocabulary)(texts())
    monkeypatch.setattr(S, "BLOCK_CHARS", 50)
    monkeypatch.setattr(S, "CACHED_WORDS", 8)
    assert S.Encoder(vocabulary)(texts()) == whole
    rows = [(i, t, "e") for i, t in enumerate(texts())] + [(None, None, "e"), (3, "", None), (3, "", None), (99, "long text " * 40_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = docs.withColumn("ids", S.encode_udf(docs, vocabulary)("text")).withColumn("back", S.decode_udf(docs, vocabulary)("ids"))
    assert out.where(F.coalesce("text", F.lit("")) != F.col("back")).count() == 0
    whole_rows = S.encode_documents(docs, vocabulary, ["doc_id"])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids) for r in whole_rows.collect()) == sorted((str(r.doc_id), len(r.ids), r.ids) for r in out.collect())
    d = docs.select("doc_id", S.digest_udf(docs, vocabulary)("text").alias("d")).select("doc_id", "d.*").collect()
    assert len(d) == len(rows) and all(r.round_trip for r in d)
    assert {r.n_tokens for r in d if r.doc_id is None} == {0}
    assert docs.where("false").select(S.digest_udf(docs, vocabulary)("text").alias("d")).count() == 0


def test_words_are_cut_where_no_piece_goes_past(vocabulary, monkeypatch):
    """Letters and other characters are encoded apart, so that a word is known with any sign after it; not if a piece has both."""
    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    met = []
    plain = S.encode_words
    monkeypatch.setattr(S, "encode_words", lambda words, v: met.extend(words) or plain(words, v))
    some = ["house, house. house; (house)\nhouse\n\nhouse $$$house### house1234 x²y² naïveté's 日本house。 áb́", "  house!?  ", "…house\thouse ² \n", "house\n "]
    encoder = S.Encoder(vocabulary)
    for t in some:
        assert encoder([t]) == [sp.encode(t)]
    assert sorted(w for w in met if "house" in w) == ["   house", " house", " 日本house", "house"]  # each once, whatever follows
    assert S.cutter(["ab", " a", "--", "a-"]).findall(" ab--a") == [" ab--a"]
    assert S.cutter(["ab", " a", "--", " -"]).findall(" ab--a -a  ") == [" ab", "--", "a", " -", "a", "  "]
    assert S.cutter(["--"]).findall(" a--") == [" a--"]
