"""Licence scan on built-in functions only: a positional index of the licences' rare words, checked by key phrases.

Templates are word sequences of licence notices or whole texts. In each
document the places of licence words are kept; of these words the ones of
highest IDF (over all documents) in this document look up the templates'
postings. A posting votes for the place where its template would start; a start
that two of the document's rare words agree on is a candidate, and its label
stands if the template's mandatory phrase is there word for word and most of
the template's words are in place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, small

#: Phrases whose consecutive words are a base place, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, notice as licence texts print it, its mandatory phrase.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "licensed under the mit license", "the mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international license", "commons attribution 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

#: Of a document's licence words so many kinds of the highest IDF look up postings, all that fewer documents have than
#: this share, and those that a possible template can't do without.
RARE_WORDS, RARE_SHARE = 24, 0.01
#: Rare words that must agree on a start, and share of a template's IDF weight that must be in place.
AGREE, COVER = 2, 0.7


def words(text: Column) -> Column:
    """Runs of digits, a-z and whatever isn't ASCII, after lower-casing A-Z only."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


#: A hit is a word's place times this, plus the word's number in the vocabulary.
WORDS = 1 << 20


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, notice, phrase in templates for w in (notice + " " + phrase).split()} | {w for p in BASE for w in p.split()})


def _word(hit: Column) -> Column:
    return hit.bitwiseAND(F.lit(WORDS - 1)).cast("int")


def _place(hit: Column) -> Column:
    return F.shiftright(hit, WORDS.bit_length() - 1)


def _places(hits: Column, phrase: str, known: list[str]) -> Column:
    """Starts of a phrase's consecutive words, from an array of the document's hits."""
    at = lambda k, i: F.transform(F.filter(hits, lambda h: _word(h) == i), lambda h: _place(h) - k)
    out = None
    for k, w in enumerate(phrase.split()):
        found = at(k, known.index(w))
        out = found if out is None else F.array_intersect(out, found)
    return out


def found_words(docs: DataFrame, templates=None) -> DataFrame:
    """(doc_id, n_words, hits): of each document the number of words, and its licence words with their places as one number each."""
    known = _vocabulary(TEMPLATES if templates is None else templates)
    listed = F.array(*map(F.lit, known))
    at = F.transform(F.col("words"), lambda w, p: F.when(w.isin(known), p.cast("long") * WORDS + F.array_position(listed, w) - 1))
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    return split.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_compact(at).alias("hits"))


def idf(rows: DataFrame, n_words: int) -> list[float]:
    """Of each licence word log(documents / documents with it), by the word's number: as many numbers as there are words come to the driver."""
    n = rows.count()
    kinds = rows.select(F.explode(F.array_distinct(F.transform("hits", _word))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    df = dict(kinds.collect())
    return [math.log((n + 1) / (df.get(w, 0) + 1)) for w in range(n_words)]


def needed(notice: list[int], weights: list[float], agree: int, cover: float) -> list[int]:
    """A template's words of highest IDF, as many that where ``cover`` of its weight is in place, so are ``agree`` of their places."""
    total, chosen, found = sum(weights[w] for w in notice), [], []
    for w in sorted(set(notice), key=lambda w: (-weights[w], w)):
        chosen.append(w)
        found += [weights[w]] * notice.count(w)
        if sum(found) - (1 - cover) * total > sum(sorted(found)[-agree + 1 :]) + 1e-9 * total:
            break
    return chosen


def aligned(hits: DataFrame, templates, weights: list[float], agree: int = AGREE, cover: float = COVER, rare_words: int = RARE_WORDS) -> DataFrame:
    """(row, label, start, cover) of verified template places, from (row, hits)."""
    spark, known = hits.sparkSession, {w: i for i, w in enumerate(_vocabulary(templates))}
    texts = [(t, label, [known[w] for w in notice.split()], [known[w] for w in phrase.split()]) for t, (label, notice, phrase) in enumerate(templates)]
    index = spark.createDataFrame([(t, label, w, p, [max(weights[i], 1e-9) for i in w]) for t, label, w, p in texts], "template int, label string, notice array<int>, phrase array<int>, weight array<double>")
    postings = index.select("template", F.posexplode("notice").alias("q", "w"))
    by_rank = F.array(*[F.lit(float(x)) for x in weights])
    # the templates whose mandatory phrase can stand here: all its words do somewhere
    kinds = F.array_distinct(F.transform("hits", _word))
    held = [max(x, 1e-9) for x in weights]
    listed = lambda ws: F.array(*map(F.lit, dict.fromkeys(ws)))
    phrases = F.array(*[F.struct(F.lit(t).alias("template"), listed(phrase).alias("words"), listed(needed(notice, held, agree, cover)).alias("needed")) for t, _, notice, phrase in texts])
    able = F.filter(phrases, lambda t: F.forall(t["words"], lambda w: F.array_contains("kinds", w)))
    some = hits.withColumn("kinds", kinds).withColumn("able", able).where(F.size("able") > 0)
    some = some.withColumn("possible", F.transform("able", lambda t: t["template"])).withColumn("needed", F.array_distinct(F.flatten(F.transform("able", lambda t: t["needed"])))).drop("able")
    # the document's own rarest licence words
    ranked = F.array_sort(F.transform("kinds", lambda w: F.struct((-F.get(by_rank, w)).alias("x"), w.alias("w"))))
    rare = F.transform(F.filter(ranked, lambda k, i: (i < rare_words) | (k["x"] <= math.log(RARE_SHARE)) | F.array_contains("needed", k["w"])), lambda k: k["w"])
    asked = some.withColumn("rare", rare).select("row", "possible", "rare", F.posexplode("hits").alias("i", "h")).where(F.array_contains("rare", _word(F.col("h"))))
    asked = asked.select("row", "possible", "i", _place(F.col("h")).alias("p"), _word(F.col("h")).alias("w"))
    votes = asked.join(F.broadcast(postings), "w").where(F.array_contains("possible", F.col("template")))
    # of a start's template, hits[first] and those after it are the only ones in place, as many as it has words
    votes = votes.select("row", "template", (F.col("p") - F.col("q")).alias("start"), (F.col("i") - F.col("q")).alias("first"))
    starts = votes.where("start >= 0").groupBy("row", "template", "start").agg(F.count("*").alias("votes"), F.max("first").alias("first"))
    starts = cut(starts.where(F.col("votes") >= agree).select("row", "template", "start", F.greatest("first", F.lit(0)).alias("first")))
    sizes = index.select("template", F.size("notice").alias("size"))
    near = F.slice("hits", F.col("first") + 1, F.col("size"))
    each = cut(hits.join(small(starts.join(F.broadcast(sizes), "template")), "row").select("row", "template", "start", near.alias("near")))
    # all words in place, by IDF weight, and the mandatory phrase within the template's stretch
    each = each.join(F.broadcast(index), "template")
    here = F.filter("near", lambda h: (_place(h) >= F.col("start")) & (_place(h) < F.col("start") + F.size("notice")))
    each = each.select("row", "label", "start", "notice", "phrase", "weight", here.alias("here"))
    key = lambda at, w: at * WORDS + w
    met = F.transform("notice", lambda w, q: F.when(F.array_contains("here", key(F.col("start") + q, w)), F.get("weight", q)).otherwise(0.0))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    stands = lambda o: F.size(F.array_except(F.transform("phrase", lambda w, k: key(F.col("start") + o + k, w)), F.col("here"))) == 0
    offsets = F.sequence(F.lit(0), F.greatest(F.size("notice") - F.size("phrase"), F.lit(0)))
    each = each.withColumn("cover", F.least(F.lit(1.0), total(met) / total(F.col("weight")))).where((F.col("cover") >= cover) & F.exists(offsets, stands))
    return each.select("row", "label", "start", "cover")


def scan_documents(docs: DataFrame, templates=None, agree: int = AGREE, cover: float = COVER, rare_words: int = RARE_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a verified template's IDF weight that is in
    place, 1 where a base phrase stands, 0 where nothing is found. A null text
    counts as empty: no words, no label. Repeated rows each have a row. Texts
    are read once and never shuffled; only the votes of rare words are.
    """
    templates = TEMPLATES if templates is None else templates
    rows = cut(found_words(docs, templates)).withColumn("row", F.monotonically_increasing_id())  # stable: of a checkpoint's partitions
    method = aligned(rows.where(F.size("hits") > 1).select("row", "hits"), templates, idf(rows, len(_vocabulary(templates))), agree, cover, rare_words)
    method = method.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
    known = _vocabulary(templates)
    base = {label: _places(F.col("hits"), phrase, known) for phrase, label in BASE.items()}
    places = rows
    for i, p in enumerate(base.values()):
        places = places.withColumn(f"base{i}", p)
    labels = F.array_compact(F.array(*[F.when(F.size(f"base{i}") > 0, F.lit(label)) for i, label in enumerate(base)]))
    starts = F.concat(*[F.col(f"base{i}") for i in range(len(base))])
    places = places.select("row", "doc_id", "n_words", starts.alias("starts"), labels.alias("base"))
    method = cut(method)
    out = places.join(small(method), "row", "left")
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("found", none))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
