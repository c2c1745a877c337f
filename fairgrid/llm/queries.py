"""The registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, balltree, ctw, decontaminate, hard_negatives, licenses, quality, secrets, sentencepiece_codec, simhash_dedup, suffix_dedup, token_shards, toxicity
from .common import fold, labelled, shared_folder, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(labelled(docs, table(spark, sf_dir, "labels"), "quality", 3, 1))
    score = quality.score_udf(docs, model)
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", quality.predicted(F.col("score")))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder and returns what a reader finds there: every slot, and the ids' hash."""
    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    token_shards.write_shards(table(spark, sf_dir, "documents"), token_shards.load_ranks(), path)
    stored = token_shards.read_shards(spark, path)
    return stored.select("slot", "shard", "offset", "n_docs", "first_doc_id", "n_tokens", token_shards.used(F.col("tokens")).alias("record_sha256"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = sentencepiece_codec.digest_udf(docs, sentencepiece_codec.load())
    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2, from_files=True)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(labelled(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2))
    score = toxicity.score_udf(docs, model)
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", toxicity.predicted(F.col("score")))


def op10_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), alignment.load())


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality, op3_token_shards, op4_simhash_dedup, op5_secrets, op6_sentencepiece, op7_context_tree, op8_licenses, op9_toxicity, op10_balltree, op11_alignment, op12_suffix_dedup, op13_hard_negatives)}

#: Where SQL can express the operator; tests hold the others against plain versions, round trips or held-out labels.
ORACLE = {
    "op10_balltree": """WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op13_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
a AS (SELECT DISTINCT vec_id, label, v FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, a.v AS av, c.vec_id, c.label, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM a JOIN v c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, own, av ORDER BY score DESC, vec_id) AS place FROM s WHERE label = own QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.own, p.av, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.av = p.av AND s.label <> p.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    # two hexadecimal digits a byte; windows that aren't the first of their content, united to spans
    "op12_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (
    SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM again)) GROUP BY doc_id, span),
gaps AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since, hi FROM spans),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS h, max(hi) AS hi, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.h || substring(d.h, 2 * kept.hi + 1), d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
